"""Scalar functions as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that give the results their meaning.
LINK_DECAY, INTEREST_DECAY, FADED = 0.995, 0.98, 0.01
HALF_LIFE, MIN_COCHANGES, MIN_CONFIDENCE, MAX_PARTNERS = 500.0, 2, 0.1, 32
LINK_CAP, LANDMARK, INTERESTING = 5.0, 3.0, 0.2
REFERENCE_CONFIDENCE = {"scip": 1.0, "import_path": 0.8, "same_file": 0.6, "name_only": 0.3}


def decayed(weight, last_seq, now, factor: float) -> Column:
    """weight * factor^(tasks since last_seq), never growing."""
    return weight * F.pow(F.lit(factor), F.greatest(now - last_seq, F.lit(0)))


def has_faded_out(weight: Column) -> Column:
    return weight < FADED


def link_share(weight: Column) -> Column:
    return F.least(F.greatest(weight / LINK_CAP, F.lit(0.0)), F.lit(1.0))


def idf_coverage(rows, holding) -> Column:
    return F.log(1 + (rows - holding + 0.5) / (holding + 0.5))


def idf_ranking(rows, holding) -> Column:
    """The form of the usual full-text rank, never below a millionth."""
    return F.greatest(F.log((rows - holding + 0.5) / (holding + 0.5)), F.lit(1e-6))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of identifiers and paths: humps and separators split, digits stay with their word."""
    humps = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.lower(humps), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_plain(text: Column) -> Column:
    """No control or hidden characters, and no tag of a reminder that a tool put in."""
    return ~text.rlike(r"[\x00-\x08\x0B-\x1F\x7F\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]|(?i)</?system-reminder")


def collapsed_hash(text: Column) -> Column:
    return F.substring(F.sha2(one_line(text), 256), 1, 32)


def count_lines(text: Column) -> Column:
    n = F.size(F.split(text, "\n"))
    return F.when(F.length(text) == 0, 0).otherwise(n - text.endswith("\n").cast("int"))


def commit_weight(anchor, seq, half_life: float = HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), (anchor - seq) / F.lit(half_life))


def partner_rank(confidence: Column, count: Column) -> Column:
    return confidence * F.log1p(count.cast("double"))


def reference_confidence(resolution: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in REFERENCE_CONFIDENCE.items():
        out = F.when(resolution == name, value).otherwise(out)
    return out


def held_out(ident: Column, share: float) -> Column:
    """A fixed share of ids, by a stable hash."""
    return F.pmod(F.conv(F.substring(F.md5(ident.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) < int(share * 1_000_000)


def tier(score: Column, is_landmark: Column) -> Column:
    return F.when(is_landmark, "landmark").when(score > INTERESTING, "interesting").otherwise("dark")


def scale_mode(files: Column, lines: Column, huge=(60_000, 5_000_000), tiny=(30, 2_000), small: int = 500) -> Column:
    return F.when((files > huge[0]) | (lines > huge[1]), "huge").when((files < tiny[0]) | (lines < tiny[1]), "tiny").when(files <= small, "small").otherwise("medium")


def failing_signature(tests: Column) -> Column:
    """The same for the same failing tests in any order."""
    return F.when(F.size(tests) > 0, F.md5(F.array_join(F.array_sort(F.array_distinct(tests)), "\n")))


def prefixes(path: Column) -> Column:
    """Folders above a path, from the top: 'a/b/c' gives a, a/b."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a time without zone, whatever the session's zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.date_part(F.lit("SECOND"), t) * 1000
    return F.unix_date(t.cast("date")).cast("long") * 86_400_000 + F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + seconds.cast("long")


def utc_text(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
