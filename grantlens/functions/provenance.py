"""Token ids, hashes, seals, weight codec and re-scoring as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ColumnLike, col, js_round

# Scoring dimensions with their short codes and default weights (0 to 10).
WEIGHT_DIMENSIONS = (
    ("federal_concentration", "fc", 6),
    ("cra_loops", "cl", 5),
    ("t3010_violations", "tv", 4),
    ("dataset_cross_coverage", "dc", 3),
)
DEFAULT_WEIGHTS = {name: default for name, _, default in WEIGHT_DIMENSIONS}
WEIGHTS_TYPE = "struct<" + ",".join(f"{name}:int" for name, _, _ in WEIGHT_DIMENSIONS) + ">"

# The disclaimers every token carries; the first is completed with the data date.
DISCLAIMER_DATE = "Data current as of "
DISCLAIMER_RESOLUTION = "Entity resolution is probabilistic for cross-dataset matches without BN anchor"
DISCLAIMER_OBSERVATIONS = "These are observations from public records. They are not findings of misconduct."

# Numbers accepted in an encoded weight, surrounding blanks allowed.
NUMBER_TEXT = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?\s*$"

JSON_OPTIONS = {"ignoreNullFields": "false"}


def canonical_json(c: ColumnLike) -> Column:
    """Compact JSON in schema order with NULL fields kept; the form all hashes are taken over."""
    return F.to_json(col(c), JSON_OPTIONS)


def evidence_hash(evidence: ColumnLike) -> Column:
    return F.sha2(canonical_json(evidence), 256)


def proof_id(entity_id: ColumnLike, finding_type: ColumnLike, ev_hash: ColumnLike, issued_at: ColumnLike) -> Column:
    """Same inputs, same id."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (entity_id, finding_type, ev_hash)]  # each keeps its place
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("ppm-"), col(issued_at), F.lit("-"), F.substring(digest, 1, 6))


def token_seal(token: ColumnLike) -> Column:
    """sha256 over the token with its own hash field blanked."""
    blank = col(token).withField("tiers.audit.tokenHash", F.lit(""))
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(blank), 256))


def standard_disclaimers(as_of: ColumnLike) -> Column:
    return F.array(
        F.concat(F.lit(DISCLAIMER_DATE), col(as_of).cast("string")),
        F.lit(DISCLAIMER_RESOLUTION),
        F.lit(DISCLAIMER_OBSERVATIONS),
    )


def poly31_hex(c: ColumnLike) -> Column:
    """32-bit polynomial hash (factor 31) over UTF-16 units, as eight hex digits."""
    packed = F.hex(F.encode(col(c), "UTF-16BE"))
    units = F.regexp_extract_all(packed, F.lit(".{4}"), F.lit(0))
    codes = F.transform(units, lambda u: F.conv(u, 16, 10).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, u: (acc * 31 + u) % F.lit(4294967296).cast("bigint"))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


# --- weights ----------------------------------------------------------------------------------


def weights_struct(values: dict[str, int]) -> Column:
    return F.struct(*[F.lit(int(values[name])).cast("int").alias(name) for name, _, _ in WEIGHT_DIMENSIONS])


def encode_weights(w: ColumnLike) -> Column:
    """fc:8,cl:5,tv:7,dc:6"""
    parts = [F.concat(F.lit(f"{code}:"), col(w)[name].cast("string")) for name, code, _ in WEIGHT_DIMENSIONS]
    return F.concat_ws(",", *parts)


def decode_weights(c: ColumnLike) -> Column:
    """Inverse of the codec: unknown codes ignored, the last duplicate wins, values held to 0..10."""
    pieces = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.split(p, ":"))

    def field(name: str, code: str, default: int) -> Column:
        # a missing number is ignored, an empty one reads as zero
        hits = F.filter(pieces, lambda p: (p[0] == code) & F.get(p, F.lit(1)).rlike(NUMBER_TEXT))
        last = F.get(F.get(hits, F.size(hits) - 1), F.lit(1))
        number = F.coalesce(F.nullif(F.trim(last), F.lit("")), F.lit("0")).try_cast("double")
        value = F.greatest(F.lit(0), F.least(F.lit(10), js_round(number)))
        return F.when(F.size(hits) > 0, value).otherwise(F.lit(default)).cast("int").alias(name)

    return F.struct(*[field(*dimension) for dimension in WEIGHT_DIMENSIONS])


def weight_total(w: ColumnLike) -> Column:
    total = F.lit(0)
    for name, _, _ in WEIGHT_DIMENSIONS:
        total = total + col(w)[name]
    return total


def rescore(score: ColumnLike, w: ColumnLike) -> Column:
    """Score scaled by the weight total relative to the defaults, held to 0..30."""
    ratio = weight_total(w) / F.lit(sum(DEFAULT_WEIGHTS.values()))
    return F.greatest(F.lit(0), F.least(F.lit(30), js_round(col(score) * ratio))).cast("int")


def rescored_summary(summary: ColumnLike) -> Column:
    stripped = F.regexp_replace(col(summary), r"[.!?]\s*\z", "")
    return F.concat(stripped, F.lit(" — re-scored under adjusted weights, sensitivity reason logged."))
