"""Deterministic ids and keys, all computed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairline import RULE_VERSION
from fairline.functions.scalars import decimal_text, utc_text

# UUID namespaces of the derived ids.
CANONICAL_NAMESPACE = "120ddf53-4180-4b56-a91e-66bd57ac1b78"
MATCHING_NAMESPACE = "f55a70c0-2aa2-46bb-963d-70b9b13070fd"
SNAPSHOT_NAMESPACE = "59cd1555-c07c-472d-9429-0f82773ad88d"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name`` as lower-case text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))

    def text(d: Column) -> Column:
        variant = F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(
            F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"), variant,
            F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12),
        )

    # One-element transform: the digest is computed once, not for each of its parts; a null name gives null.
    return F.get(F.transform(F.array(digest), text), F.lit(0))


def canonical_id(bookmaker_id: Column, entity_type: Column | str, source_id: Column) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return uuid5(CANONICAL_NAMESPACE, F.concat(bookmaker_id, F.lit(":"), kind, F.lit(":"), source_id))


def unnamed_selection_id(
    market_id: Column, selection_type: Column, participant_source_id: Column, line: Column, label: Column
) -> Column:
    """Id of a selection whose source gives none."""
    identity = F.concat(
        F.lit("selection:"),
        market_id,
        F.lit("|"),
        F.coalesce(selection_type, F.lit("unknown")),
        F.lit("|"),
        F.coalesce(participant_source_id, F.lit("")),
        F.lit("|"),
        F.coalesce(decimal_text(line), F.lit("")),
        F.lit("|"),
        label,
    )
    return uuid5(CANONICAL_NAMESPACE, identity)


def mapping_id(bookmaker_id: Column, entity_type: Column, source_id: Column) -> Column:
    return uuid5(
        MATCHING_NAMESPACE,
        F.concat(F.lit("mapping:"), bookmaker_id, F.lit(":"), entity_type, F.lit(":"), source_id),
    )


def decision_id(key: Column) -> Column:
    return uuid5(MATCHING_NAMESPACE, F.concat(F.lit("decision:"), key))


def decision_key(
    bookmaker_id: Column,
    entity_type: Column | str,
    source_id: Column,
    fingerprint: Column,
    rule_version: str = RULE_VERSION,
) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.sha2(F.concat_ws("|", bookmaker_id, kind, source_id, fingerprint, F.lit(rule_version)), 256)


def _digest(struct: Column) -> Column:
    return F.sha2(F.to_json(struct, {"ignoreNullFields": "false"}), 256)


def competition_fingerprint(sport_id: Column, name: Column, country: Column, season: Column, gender: Column) -> Column:
    """All arguments already normalised; fields are in alphabetical order."""
    return _digest(
        F.struct(
            country.alias("country"),
            gender.alias("gender"),
            name.alias("name"),
            season.alias("season"),
            sport_id.alias("sport_id"),
        )
    )


def participant_fingerprint(sport_id: Column, name: Column, kind: Column, country: Column) -> Column:
    return _digest(
        F.struct(
            country.alias("country"), name.alias("name"), sport_id.alias("sport_id"), kind.alias("type")
        )
    )


def event_fingerprint(
    sport_id: Column,
    competition_source_id: Column,
    competition_id: Column,
    participants: Column,
    start_time: Column,
    name: Column,
    out_of_scope_live: Column,
) -> Column:
    """``participants`` is an array of structs (source_id, canonical_id, role, position).

    The list is ordered by canonical id, then source id; an unresolved id sorts as the text
    ``None``.
    """
    keyed = F.transform(
        participants,
        lambda p: F.struct(
            F.coalesce(p["canonical_id"], F.lit("None")).alias("k1"),
            p["source_id"].alias("k2"),
            F.struct(
                p["canonical_id"].alias("canonical_id"),
                p["position"].alias("position"),
                p["role"].alias("role"),
                p["source_id"].alias("source_id"),
            ).alias("item"),
        ),
    )
    ordered = F.transform(F.array_sort(keyed), lambda p: p["item"])
    return _digest(
        F.struct(
            competition_id.alias("competition_id"),
            competition_source_id.alias("competition_source_id"),
            name.alias("name"),
            out_of_scope_live.alias("out_of_scope_live"),
            ordered.alias("participants"),
            sport_id.alias("sport_id"),
            utc_text(start_time).alias("start_time"),
        )
    )


def observation_key(
    bookmaker_id: Column,
    selection_id: Column,
    decimal_odds: Column,
    is_available: Column,
    observed_at: Column,
    source_updated_at: Column,
) -> Column:
    """Replay identity of one quote: the source's timestamp when there is one, else retrieval time."""
    return F.sha2(
        F.concat_ws(
            "|",
            bookmaker_id,
            selection_id,
            F.coalesce(decimal_text(decimal_odds), F.lit("")),
            F.when(is_available, "1").otherwise("0"),
            utc_text(F.coalesce(source_updated_at, observed_at)),
        ),
        256,
    )


def quote_id(key: Column) -> Column:
    return uuid5(CANONICAL_NAMESPACE, F.concat(F.lit("quote:"), key))


def snapshot_id(
    bookmaker_id: Column,
    market_id: Column,
    identity_time: Column,
    status: Column,
    is_live: Column,
    selection_state: Column,
) -> Column:
    return uuid5(
        SNAPSHOT_NAMESPACE,
        F.concat_ws(
            "|",
            bookmaker_id,
            market_id,
            utc_text(identity_time),
            status,
            F.when(is_live, "1").otherwise("0"),
            selection_state,
        ),
    )
