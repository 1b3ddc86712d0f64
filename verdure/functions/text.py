"""Text and label expressions, all as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("unspecified", "unknown", "none", "nan", "na", "")


def locus(c: Column) -> Column:
    """The first locus code in a text, upper-cased; NULL if there is none."""
    return F.upper(F.nullif(F.regexp_extract(c, r"(?i)(AT[1-5MC]G\d{5})", 1), F.lit("")))


def make_names(c: Column) -> Column:
    """A syntactic name: other characters than letters, digits and _ become dots; X before a digit or a dot."""
    s = F.regexp_replace(c, r"[^A-Za-z0-9_]", ".")
    return F.when(s.rlike(r"^[0-9.]"), F.concat(F.lit("X"), s)).otherwise(s)


def parts(c: Column, sep: str = r"\+") -> Column:
    return F.transform(F.split(c, sep), lambda x: F.trim(x))


def has_treatment(c: Column, name: str) -> Column:
    return F.array_contains(parts(F.coalesce(c, F.lit(""))), name)


def is_pure(c: Column, name: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == name


def is_valid(c: Column, missing: tuple[str, ...] = MISSING) -> Column:
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*missing)


def ladder(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found, any case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = reduce(lambda w, kv: w.when(low.rlike(kv[0]), kv[1]), rules[1:], F.when(low.rlike(rules[0][0]), rules[0][1]))
    return out.otherwise(default)


def flags(c: Column, patterns: list[str]) -> Column:
    """Those of the patterns (as whole words, any case) that are in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.when(low.rlike(rf"\b{p}\b"), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())


def bucket(c: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The name of the first (largest) bound that c reaches."""
    out = reduce(lambda w, kv: w.when(c >= kv[0], kv[1]), steps[1:], F.when(c >= steps[0][0], steps[0][1]))
    return out.otherwise(below)


def duration(seconds: Column) -> Column:
    """2h 14m, 37m 05s or 12s."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    return F.when(s >= 3600, F.format_string("%dh %02dm", h, m % 60)).when(s >= 60, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def neg_log10(p: Column, floor: float = 1e-10) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def file_score(name: Column, hard_skip: str, normalised: str, count_word: str) -> Column:
    """-1 for files to skip, else 10 for a count word, 5 for a series prefix, 2 for gzip."""
    low = F.lower(name)
    one = lambda c, n: F.when(c, n).otherwise(0)
    good = one(low.rlike(count_word), 10) + one(name.rlike(r"^GSE\d+"), 5) + one(low.endswith(".gz"), 2)
    return F.when(low.rlike(hard_skip) | low.rlike(normalised), -1).otherwise(good)


def clean_term(c: Column, ignore: tuple[str, ...] = ("none", "nan")) -> Column:
    """Brackets, quotes and blanks off both ends, capitals first; '' for words to ignore."""
    s = F.btrim(c, F.lit("[]'\" {}"))
    return F.when(F.lower(s).isin(*ignore), "").otherwise(F.initcap(s))


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def sorted_join(c: Column, sep: str = "_") -> Column:
    return F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), sep)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def migrated(v: Column) -> Column:
    """A label map's entry of any version, as a Variant, as (label, studies): a name; a name and a list of studies; an object with label and studies (by name, in the order of names)."""
    kind = F.schema_of_variant(v)
    get = lambda path, t: F.try_variant_get(v, path, t)
    label = F.when(kind == "STRING", get("$", "string")).when(kind.startswith("ARRAY"), get("$[0]", "string")).otherwise(get("$.label", "string"))
    none = F.array().cast("array<string>")
    listed = F.coalesce(get("$[1]", "array<string>"), none)
    keyed = F.coalesce(F.map_keys(get("$.studies", "map<string,variant>")), get("$.studies", "array<string>"), none)
    return F.struct(label.alias("label"), F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), keyed).otherwise(none).alias("studies"))


def first_object(c: Column) -> Column:
    """An answer without code fences and blanks around it; of one that holds an object amid words, the first {...}."""
    bare = F.btrim(F.regexp_replace(c, r"```(?:json)?\s*|\s*```", ""), F.lit(" \t\r\n"))
    return F.when(bare.startswith("{"), bare).otherwise(F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\{.*?\}", 0), F.lit("")), bare))


def floored(p: Column, least: Column) -> Column:
    """p, or `least` (say, the smallest p above zero) where p is below it; 1e-300 where there is none."""
    return F.greatest(p, F.coalesce(least, F.lit(1e-300)))


def minus_ln(p: Column, add: float = 1e-10) -> Column:
    return -F.log(p + add)


def value_of(json: Column) -> Column:
    """Of an object the value under val, else under value; of anything else itself; as text."""
    v = F.try_parse_json(json)
    return F.coalesce(F.try_variant_get(v, "$.val", "string"), F.try_variant_get(v, "$.value", "string"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string")))


def with_sub(base: Column, key: Column, value: Column) -> Column:
    """Base (Key: Val), or Base alone without a value; Unspecified without a base."""
    b = F.nullif(clean_term(F.coalesce(base, F.lit(""))), F.lit(""))
    some = F.nullif(clean_term(F.coalesce(value.cast("string"), F.lit(""))), F.lit(""))
    return F.when(b.isNull(), "Unspecified").when(some.isNull(), b).otherwise(F.concat(b, F.lit(" ("), F.initcap(key), F.lit(": "), some, F.lit(")")))
