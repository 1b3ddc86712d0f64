"""Labels given as JSON, held against an ontology: parsed, validated, flattened; annotations carried up within a scope.

JSON stays a Variant until each item's kind is known, so lists, single values, objects and objects in lists are told apart
without a schema. Canonical names are an ontology's, gathered and sent along; a document is worked on where it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.operators.enrich import ancestor_lists
from verdure.storage import cut, uncut

#: What stands for no label when axes are flattened, and the label of those that have none.
EMPTY, UNSPECIFIED = ("none", "", "nan", "unknown"), "unspecified"


def parsed(text: Column) -> Column:
    """The JSON of an answer as a Variant: code fences off, else the first {...} in it; NULL if neither is JSON."""
    bare = F.btrim(F.regexp_replace(text, r"```(?:json)?\s*|\s*```", ""), F.lit(" \t\r\n"))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*?\}", 0), F.lit(""))))


def _unquoted(c: Column) -> Column:
    return F.btrim(c, F.lit("\"' \t\n\x0b\f\r"))


def _items(value: Column) -> Column:
    """Variant -> its items: those of a list, else the value itself; none for NULL, a JSON null or the word unspecified."""
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<variant>")
    one = F.when((kind == "VOID") | ((kind == "STRING") & (F.try_variant_get(value, "$", "string") == UNSPECIFIED)), none).otherwise(F.array(value))
    return F.when(value.isNull(), none).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(one)


def _whole_number(item: Column, path: str) -> Column:
    """A whole number as such, as text, or cut off from a number with a fraction; NULL for anything else."""
    text = F.try_variant_get(item, path, "string")
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*$", 1).try_cast("long")
    kind = F.schema_of_variant(F.try_variant_get(item, path, "variant"))
    return F.when(kind == "STRING", digits).when(kind == "BOOLEAN", F.try_variant_get(item, path, "boolean").cast("long")).otherwise(F.try_variant_get(item, path, "double").try_cast("long"))


def _canonical(names: list, low: Column) -> Column:
    """The name of these letters, else 'unspecified'. names: (letters, name, crc32 of the letters), kept in maps of a few entries each."""
    n = 1 + len(names) // 16
    parts = [[F.lit(x) for r in names if r[2] % n == k for x in r[:2]] for k in range(n)]
    maps = F.array(*[F.create_map(*part).cast("map<string,string>") for part in parts])
    return F.coalesce(F.element_at(F.get(maps, (F.crc32(low) % n).cast("int")), low), F.lit(UNSPECIFIED))


def _held(items: Column, names: list, subs: dict[str, list], best: str | None, rest: str) -> Column:
    """Items as {i, val, subs, s}: their place, name, sub-attributes and, as a number, the sub-attribute `best`; items named `rest` have its first allowed value."""

    def read(x):
        name = F.when(x["is_object"], F.coalesce(F.try_variant_get(x["item"], "$.val", "string"), F.lit(UNSPECIFIED))).otherwise(F.try_variant_get(x["item"], "$", "string"))
        given = lambda sub, first: (_whole_number(x["item"], f"$.{sub}") if isinstance(first, int) else F.try_variant_get(x["item"], f"$.{sub}", "string")).cast("string")
        return F.struct(F.lower(_unquoted(name)).alias("low"), *[F.when(x["is_object"], given(sub, allowed[0])).alias(sub) for sub, allowed in subs.items()])

    def named(x):
        good = [F.when(x[sub].isin([str(a) for a in allowed]), x[sub]).otherwise(str(allowed[0])).alias(sub) for sub, allowed in subs.items()]
        return F.struct(_canonical(names, x["low"]).alias("val"), *good)

    def with_subs(x, i):
        held = {sub: F.when(F.lower(x["val"]) == rest.lower(), str(allowed[0])).otherwise(x[sub]) if sub == best else x[sub] for sub, allowed in subs.items()}
        pairs = F.create_map(*[c for sub, value in held.items() for c in (F.lit(sub), value)]).cast("map<string,string>")
        return F.struct(i.alias("i"), x["val"].alias("val"), pairs.alias("subs"), (held[best] if best else F.lit(None)).cast("long").alias("s"))

    known = F.transform(items, lambda x: F.struct(x.alias("item"), F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)).alias("is_object")))
    return F.transform(F.transform(F.transform(known, read), named), with_subs)


def validated(df: DataFrame, json: str, canonical: DataFrame, subs: dict[str, dict[str, list]] | None = None, key: str = "id", strongest: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(key, axis, items): for each row and axis of canonical (axis, name) the items of its label, {val, subs}.

    val is the canonical name of the same letters, whatever their case, quotes and blanks around it, else 'unspecified'; of names of the same
    letters the least. subs: for an axis, its sub-attributes and their allowed values, all whole numbers or all text; a value that isn't allowed is the first
    one allowed. strongest: for an axis (sub-attribute, rest): of items of one name the one with the largest sub-attribute stays, where the
    first of them stood, and items named `rest` have the first allowed value. No item at all, no JSON or NULL: one item 'unspecified'.
    A row is worked on where it stands and nothing is shuffled; the names of the ontology are gathered and sent along.
    """
    subs, strongest = subs or {}, strongest or {}
    known = canonical.groupBy("axis", F.lower("name").alias("low")).agg(F.min("name").alias("name")).select("axis", "low", "name", F.crc32("low").alias("crc")).collect()
    axes = sorted({r.axis for r in known})
    at = [(f"_{k}", a, *strongest.get(a, (None, ""))) for k, a in enumerate(axes)]
    v = df.select(key, parsed(F.col(json)).alias("_v")).select(key, *[F.try_variant_get("_v", f"$.{a}", "variant").alias(c) for c, a, *_ in at])
    v = v.select(key, *[_items(F.col(c)).alias(c) for c, *_ in at])
    none = F.array(F.lit(None).cast("variant"))
    names = {a: [(r.low, r.name, r.crc) for r in known if r.axis == a and r.low is not None] for a in axes}
    v = v.select(key, *[_held(F.when(F.size(c) > 0, F.col(c)).otherwise(none), names[a], subs.get(a, {}), best, rest).alias(c) for c, a, best, rest in at])

    def strongest_of(c: str) -> Column:
        """Of each name the strongest item, the first of equals, in order of the names' first places."""
        x, same = F.col(c), lambda x, y: x["val"] == y["val"]
        top = F.filter(x, lambda a: ~F.exists(x, lambda b: same(a, b) & ((b["s"] > a["s"]) | ((b["s"] == a["s"]) & (b["i"] < a["i"])))))
        first = F.filter(x, lambda a: ~F.exists(x, lambda b: same(a, b) & (b["i"] < a["i"])))
        return F.when(F.size(F.array_distinct(F.transform(x, lambda a: a["val"]))) == F.size(x), x).otherwise(F.transform(first, lambda a: F.element_at(F.filter(top, lambda b: same(a, b)), 1)))

    short = lambda c: F.transform(c, lambda x: F.struct(x["val"].alias("val"), x["subs"].alias("subs")))
    return v.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), short(strongest_of(c) if best else F.col(c)).alias("items")) for c, a, best, _ in at])).alias("_a")).select(key, "_a.*")


def flattened(labels: DataFrame, key: str = "id") -> DataFrame:
    """(key, axis, value) of validated labels: names joined by ' + ', and axis_<sub> for sub-attributes; 'unspecified' for none and for words that say nothing. One pass over labels."""
    tidy = lambda c: F.when(F.lower(c).isin(*EMPTY), UNSPECIFIED).otherwise(c)
    pair = lambda axis, value: F.struct(axis.alias("axis"), value.alias("value"))
    own = pair(F.col("axis"), tidy(F.when(F.size("items") == 0, UNSPECIFIED).otherwise(F.array_join(F.transform("items", lambda x: x["val"]), " + "))))
    keys = F.coalesce(F.array_distinct(F.flatten(F.transform("items", lambda x: F.map_keys(x["subs"])))), F.array().cast("array<string>"))
    more = F.transform(keys, lambda sub: pair(F.concat_ws("_", F.col("axis"), sub), F.array_join(F.filter(F.transform("items", lambda x: F.element_at(x["subs"], sub)), lambda x: x.isNotNull()), " + ")))
    return labels.select(key, F.explode(F.concat(F.array(own), more)).alias("_a")).select(key, "_a.*")


def reach(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node) of the roots and all below them, a level at a time; each node is met once, whatever the number of ways to it."""
    e = edges.select(F.col(parent).alias("_p"), F.col(child).alias("node")).where("_p IS NOT NULL AND node IS NOT NULL")
    seen = now = cut(roots.toDF("node").where("node IS NOT NULL").distinct(), "reach")
    while True:
        new = cut(e.join(now.withColumnRenamed("node", "_p"), "_p", "left_semi").select("node").distinct().join(seen, "node", "left_anti"), "reach")
        if new.isEmpty():
            uncut(new)
            return seen
        seen, now = seen.unionByName(new), new


def scoped_lists(edges: DataFrame, terms: DataFrame, roots: DataFrame | None = None, namespaces: tuple[str, ...] = (), child: str = "child", parent: str = "parent", term: str = "go_id") -> DataFrame:
    """(node, ancestors) of known terms (term, namespace), every term with itself, whose ancestor is a root or below one, and of one of the namespaces; a list may be empty.

    Edges outside what the roots reach are dropped before anything is carried up: what lies between a term and an ancestor below a root is below it too. Namespaces can be crossed on the way, so only lists go without the others.
    """
    known = terms.select(F.col(term).alias("node")).distinct()
    e = cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")), "edges")
    if roots is not None:
        known = cut(reach(e, roots.toDF("node").join(known, "node", "left_semi")).join(known, "node", "left_semi"), "scope")
        for c in ("child", "parent"):
            e = e.join(known.withColumnRenamed("node", c), c, "left_semi")
    keep = terms.where(F.col("namespace").isin(*namespaces)).select(F.col(term).alias("ancestor")) if namespaces else None
    lists = ancestor_lists(e, keep)
    if roots is None:
        lists = lists.join(known, "node", "left_semi")
    alone = known.join(lists.select("node"), "node", "left_anti").select("node", F.col("node").alias("ancestor"))
    alone = alone if keep is None else alone.join(keep, "ancestor", "left_semi")
    return lists.unionByName(alone.select("node", F.array("ancestor").alias("ancestors")))


def scoped_closure(edges: DataFrame, terms: DataFrame, roots: DataFrame | None = None, namespaces: tuple[str, ...] = (), child: str = "child", parent: str = "parent", term: str = "go_id") -> DataFrame:
    """(node, ancestor): the pairs of scoped_lists, each once."""
    return scoped_lists(edges, terms, roots, namespaces, child, parent, term).select("node", F.explode("ancestors").alias("ancestor"))


def propagated(annotation: DataFrame, up: DataFrame, gene: str = "gene_id", term: str = "go_id") -> DataFrame:
    """(gene, term): annotations carried to all ancestors within the scope of `up`, as lists or as pairs; terms outside it are left out. A gene's lists are sent, and told apart where they arrive."""
    up = up if "ancestors" in up.columns else up.select("node", F.array("ancestor").alias("ancestors"))
    met = annotation.select(gene, term).distinct().join(up, F.col(term) == F.col("node")).where(F.size("ancestors") > 0)
    return met.select(gene, "ancestors").repartition(gene).select(gene, F.explode("ancestors").alias(term)).distinct()
