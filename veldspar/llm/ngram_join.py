"""N-gram Jaccard join of documents with themselves: a grouped prefix join.

Documents become sets of distinct k-word shingle hashes and link when 100 * |x n y| >= percent * |x u y|.

1. Equal sets are one class; from here on classes stand for their documents (copies are linked by definition).
2. A global order puts frequent shingles last (counted over the regions where prefixes lie), hashes break ties. The
   order decides speed alone: the prefix filter is exact under any order, so the list of frequent shingles may be bounded.
3. Classes with equal prefix and equal size form a group. Groups meet in the posting lists of their prefix shingles.
4. First round: in each list only PIVOTS groups, the first by a hash, are paired with the others, and in each group its
   head with the others. Verified links are contracted to components. In a large family in which one pair in four
   links, all but a hundredth then is one component.
5. Second round: all remaining group pairs of each list, of different components, that pass the size filter, the
   position filter and a parity-bitmap bound on the symmetric difference (of groups: on the bits in which all members of
   one differ from all of the other), are expanded to members and verified. Long lists, whose pairs grow with the square of their
   length, hold them against whole bitmaps while they are joined, short lists against folded ones. Pairs
   within a component need no check, so components are exact although not every link of a large family is visited.

Edge cases: null, empty and blank text has an empty set, linked with nothing; with fewer than k words the whole
sequence is one shingle; a null id is returned with null component_id and takes no part; rows that share an id take part
each with its text; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldspar.llm import numtext
from veldspar.llm.components import components
from veldspar.llm import store
from veldspar.llm.store import cut, passing, short_batches, table
from veldspar.llm.text import row_key

#: A shingle in more than FREQUENT regions goes last in the order, as far as the list of the most frequent ones, of
#: at most LISTED, holds it (8 bytes each, broadcast).
FREQUENT, LISTED = 16, 500_000
#: 64-bit words of the parity bitmap that pairs are held against, and of its fold that postings carry.
WORDS, FOLD = 16, 4
#: Shingles of the documents of one batch that goes back to the JVM, but for its last document.
HELD = 250_000
#: Most bytes of a table that one join broadcasts. There are some fifty joins, so that all together send at most 200 MB.
SHARED = 4 << 20
#: Groups of each posting list that the first round pairs with all others of the list.
PIVOTS = 16
#: Postings of a list from which on they carry whole bitmaps in the second round. A shorter list makes fewer rows than this for each posting.
LONG = 32


def hinted(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    return store.hinted(df, SHARED, of)


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _class_id(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(numtext.mix(np.array([numtext.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _run(docs: DataFrame, columns: list[str], schema: str, each, k: int) -> DataFrame:
    """Rows each(id, set) over the shingle sets of `docs` (doc_id, t), in Arrow batches."""

    def batches(it):
        for b in it:
            ids, out, held = b.column(0).to_pylist(), [], 0
            for r, s in numtext.shingle_sets(b.column(1), k):
                out.append(each(ids[r], s))
                held += len(s)
                if len(out) == 2000 or held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)

    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[f.strip().split(" ")[1]] for f in schema.split(",")]
    return docs.mapInArrow(batches, schema)


def _order(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """The most frequent shingles of the regions where prefixes lie, ascending."""

    def region(_, s):
        return (s[: 2 * _prefix_length(len(s), percent)].view(np.int64),)

    hashes = _run(docs, ["r"], "r array<long>", region, k).select(F.explode("r").alias("h"))
    top = hashes.groupBy("h").count().filter(F.col("count") > FREQUENT).orderBy(F.desc("count"), "h").limit(LISTED)
    return np.sort(top.select("h").toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, frequent, k: int, percent: int) -> DataFrame:
    """c, n, g (identity of the prefix and size), prefix (in order), and the parity bitmap."""

    def prefix(_, s):
        last = frequent.value
        late = np.zeros(len(s), bool)
        if len(last):
            at = np.minimum(np.searchsorted(last, s), len(last) - 1)
            late = last[at] == s
        p = np.concatenate((s[~late], s[late]))[: _prefix_length(len(s), percent)]
        bits = np.zeros(WORDS, np.uint64)
        np.bitwise_xor.at(bits, (s >> np.uint64(20)) % np.uint64(WORDS), np.uint64(1) << (s & np.uint64(63)))
        key = np.uint64(_class_id(np.concatenate((p, np.array([len(s)], np.uint64)))) & 0xFFFFFFFFFFFFFFFF)
        return (_class_id(s), len(s), int(key.view(np.int64)), p.view(np.int64), *bits.view(np.int64).tolist())

    names = [f"b{i}" for i in range(WORDS)]
    return _run(docs, ["c", "n", "g", "prefix", *names], "c long, n int, g long, prefix array<long>, " + ", ".join(f"{b} long" for b in names), prefix, k)


def _folded(i: int) -> Column:
    """Word i of the folded bitmap: also a parity bitmap, of fewer bits."""
    return reduce(lambda x, y: x.bitwiseXOR(y), [F.col(f"b{j}") for j in range(i, WORDS, FOLD)]).alias(f"b{i}")


def _sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def _band(n: Column, percent: int) -> Column:
    """Band of a size, wider by a hundredth than the sizes that link with one: of a linked pair the larger is in the same band or the next."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(101.0 / percent))).cast("int")


def _positions_fit(a, b, percent: int) -> Column:
    """The first common shingle of a linked pair leaves enough room behind it on both sides."""
    return F.least(a("n") - a("pos"), b("n") - b("pos")) * (100 + percent) >= (a("n") + b("n")) * percent


def _room(total: Column, percent: int) -> Column:
    """Largest symmetric difference of two linked sets that have `total` shingles together."""
    return total - 2 * F.ceil(total * percent / (100 + percent) - 1e-9)


def _bits_fit(a, b, percent: int, words: int) -> Column:
    """Bits in which parity bitmaps differ never exceed the symmetric difference; a linked pair's is bounded."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(a(f"b{i}").bitwiseXOR(b(f"b{i}"))) for i in range(words)])
    return differ <= _room(a("n") + b("n"), percent)


def _group_bits(bits: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per group (by its head): the size, the bits that all members set (l0..) and those that any member sets (h0..)."""
    several = grouped.groupBy("head").agg(F.min("n").alias("n"), *[F.bit_and(f"b{i}").alias(f"l{i}") for i in range(WORDS)], *[F.bit_or(f"b{i}").alias(f"h{i}") for i in range(WORDS)])
    alone = bits.join(hinted(grouped.select("c"), grouped), "c", "left_anti")
    return several.unionByName(alone.select(F.col("c").alias("head"), "n", *[F.col(f"b{i}").alias(x) for x, i in ((f"{y}{i}", i) for y in "lh" for i in range(WORDS))]))


def _may_link(low, high, total: Column, percent: int) -> Column:
    """Bits that one side sets (low) and the other doesn't (high) never exceed the symmetric difference; see _bits_fit.

    low(side, i) and high(side, i) give word i of the bits that side 0 or 1 sets for sure and of those that it may set.
    """
    only = lambda s, i: low(s, i).bitwiseAND(F.bitwise_not(high(1 - s, i)))
    differ = reduce(lambda p, q: p + q, [F.bit_count(only(0, i).bitwiseOR(only(1, i))) for i in range(WORDS)])
    return differ <= _room(total, percent)


def _met(left: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Pairs (ga, gb) of groups that meet in a list of the postings `left`, once for each list, and of which some members may link.

    Linked sizes are in the same or in neighbouring bands: a list is met band by band, not as a whole. `whole`: postings carry the
    words of `_group_bits` beside the folded bitmaps, as arrays `low` and `high` (a condition on so many columns would be too long for
    the JVM's compiler), and the join makes only pairs that these leave too.
    """
    a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    x = left.withColumn("band", _band(F.col("n"), percent)).alias("x")
    y = left.withColumn("band", F.explode(F.array(_band(F.col("n"), percent), _band(F.col("n"), percent) - 1))).alias("y")
    smaller = (a("n") < b("n")) | (a("n") == b("n")) & (a("c") < b("c"))
    apart = ~F.coalesce(a("root") == b("root"), F.lit(False))
    fits = smaller & apart & _sizes_fit(a("n"), b("n"), percent) & _positions_fit(a, b, percent) & (~(a("alone") & b("alone")) | _bits_fit(a, b, percent, FOLD))
    if whole:
        only = lambda p, q: F.zip_with(p("low"), q("high"), lambda low, high: low.bitwiseAND(F.bitwise_not(high)))
        differ = F.aggregate(F.zip_with(only(a, b), only(b, a), lambda p, q: F.bit_count(p.bitwiseOR(q))), F.lit(0), lambda s, n: s + n)
        fits &= differ <= _room(a("n") + b("n"), percent)
    return x.join(y, (a("h") == b("h")) & (a("band") == b("band")) & fits).select(a("c").alias("ga"), b("c").alias("gb"))


def _groups_fit(pairs: DataFrame, spans: DataFrame, percent: int) -> DataFrame:
    """The group pairs (ga, gb) of which some members may link."""
    low, high = (lambda s, i: F.col(f"{'xy'[s]}.l{i}")), (lambda s, i: F.col(f"{'xy'[s]}.h{i}"))
    sides = pairs.join(spans.alias("x"), F.col("ga") == F.col("x.head")).join(spans.alias("y"), F.col("gb") == F.col("y.head"))
    return sides.filter(_may_link(low, high, F.col("x.n") + F.col("y.n"), percent)).select("ga", "gb")


def _expanded(pairs: DataFrame, bits: DataFrame, grouped: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Group pairs as pairs (u, v) of members of different components that may link.

    Each join that expands a side holds its members against the other side's bits, so that it makes only such rows.
    """
    each = grouped.select("head", *bits.columns).unionByName(bits.join(hinted(grouped.select("c"), grouped), "c", "left_anti").withColumn("head", F.col("c")))
    each = each.join(hinted(roots.withColumnRenamed("node", "c"), roots), "c", "left").withColumn("root", F.coalesce("root", "c"))
    spans = _group_bits(bits, grouped)
    word = lambda s, i: F.col(f"{'xy'[s]}.b{i}")
    low, high = (lambda s, i: F.col(f"y.l{i}") if s else word(0, i)), (lambda s, i: F.col(f"y.h{i}") if s else word(0, i))
    total = F.col("x.n") + F.col("y.n")
    fits = _may_link(low, high, total, percent)
    half = pairs.join(spans.alias("y"), F.col("gb") == F.col("y.head")).join(each.alias("x"), (F.col("ga") == F.col("x.head")) & fits).select("gb", "x.c", "x.n", "x.root", *[word(0, i) for i in range(WORDS)])
    apart = (F.col("x.c") != F.col("y.c")) & (F.col("x.root") != F.col("y.root"))
    whole = half.alias("x").join(each.alias("y"), (F.col("x.gb") == F.col("y.head")) & apart & _may_link(word, word, total, percent))
    return whole.select(F.greatest("x.c", "y.c").alias("u"), F.least("x.c", "y.c").alias("v")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, bits: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that link: by their bitmaps they may, by exact intersection of their whole sets they do."""
    x, y = bits.alias("x"), bits.alias("y")
    a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    may = pairs.join(x, F.col("u") == a("c")).join(y, F.col("v") == b("c")).filter(_sizes_fit(a("n"), b("n"), percent) & _bits_fit(a, b, percent, WORDS))
    pairs = cut(may.select("u", "v"), "ngram-pairs")
    wanted = cut(pairs.select(F.col("u").alias("c")).unionByName(pairs.select(F.col("v").alias("c"))).distinct().join(classes, "c").select("c", "rep"), "ngram-wanted")
    texts = docs.join(hinted(wanted.select(F.col("rep").alias("doc_id")).distinct(), wanted), "doc_id", "left_semi")
    sets = _run(texts, ["c", "s"], "c long, s array<long>", lambda _, s: (_class_id(s), s.view(np.int64)), k)
    sets = cut(sets.join(hinted(wanted.select("c"), wanted), "c", "left_semi").dropDuplicates(["c"]), "ngram-sets")
    u, v = sets.select(F.col("c").alias("u"), F.col("s").alias("su")), sets.select(F.col("c").alias("v"), F.col("s").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return pairs.join(u, "u").join(v, "v").filter(shared * 100 >= (F.size("su") + F.size("sv") - shared) * percent).select("u", "v")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (least id reachable by links), a cut table. Ids are longs, or binary.

    The tables that the steps cut are deleted at the end, and the caller's settings are as they were.
    """
    with passing(), short_batches(docs.sparkSession):
        return cut(_components(docs, k, percent, id_col, text_col), "ngram-components", keep=True)


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    kind = "binary" if dict(docs.dtypes)[id_col] == "binary" else "long"
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sketch = cut(_run(rows, ["doc_id", "n", "c"], f"doc_id {kind}, n int, c long", lambda i, s: (i, len(s), _class_id(s)), k), "ngram-sketch")
    named = rows.filter("doc_id IS NOT NULL")
    classes = cut(sketch.filter("doc_id IS NOT NULL AND n > 0").groupBy("c").agg(F.min("doc_id").alias("rep")), "ngram-classes")

    frequent = spark.sparkContext.broadcast(_order(named, k, percent))
    each = cut(_prefixes(named, frequent, k, percent).filter("n > 0").dropDuplicates(["c"]), "ngram-prefixes")
    frequent.unpersist()
    bits = each.select("c", "n", *[f"b{i}" for i in range(WORDS)])

    # Groups of more than one class; a group goes by its least class, its head. Only heads are posted.
    multi = cut(each.groupBy("g").agg(F.min("c").alias("head"), F.count("*").alias("members")).filter("members > 1"), "ngram-groups")
    grouped = cut(each.join(hinted(multi, multi), "g").select("head", "members", *bits.columns), "ngram-members")
    others = grouped.filter("c <> head")
    postings = each.join(hinted(others.select("c"), grouped), "c", "left_anti").select("c", "n", F.posexplode("prefix").alias("pos", "h"))
    repeated = cut(postings.groupBy("h").count().filter("count > 1").select("h"), "ngram-repeated")
    lists = cut(postings.join(hinted(repeated, repeated), "h").select("h", "c", "n", "pos"), "ngram-lists")

    # First round: a few groups of each list against the others; each group's head against its other classes.
    rank = F.row_number().over(W.partitionBy("h").orderBy(F.xxhash64("c"), "c"))
    pivots = lists.withColumn("r", rank).filter(F.col("r") <= PIVOTS).drop("r")
    x, y = lists.alias("x"), cut(pivots, "ngram-pivots").alias("p")
    a, b = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"p.{c}"))
    near = x.join(y, (a("h") == b("h")) & (a("c") != b("c")) & _sizes_fit(a("n"), b("n"), percent) & _positions_fit(a, b, percent))
    star = near.select(F.greatest(a("c"), b("c")).alias("u"), F.least(a("c"), b("c")).alias("v"))
    inner = others.select(F.greatest("c", "head").alias("u"), F.least("c", "head").alias("v"))
    links = _verified(star.unionByName(inner).distinct(), named, classes, bits, k, percent)
    roots = cut(components(links), "ngram-roots")

    # Second round: what is left between components, at group level first. A group of several components has root null.
    own = grouped.join(hinted(roots.withColumnRenamed("node", "c"), roots), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = cut(own.groupBy("head").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("head"), "ngram-mixed")
    labelled = lists.join(hinted(roots.withColumnRenamed("node", "c"), roots), "c", "left").join(hinted(mixed.withColumnRenamed("head", "m").withColumn("is_mixed", F.lit(True)), mixed), F.col("c") == F.col("m"), "left")
    labelled = labelled.select("h", "c", "n", "pos", F.when(F.col("is_mixed").isNull(), F.coalesce("root", "c")).alias("root"))
    several = labelled.groupBy("h").agg(F.count_if(F.col("root").isNull()).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), (F.count("*") >= LONG).alias("long"))
    heads, several = multi.select(F.col("head").alias("c"), "members"), cut(several.filter("m > 0 OR lo <> hi").select("h", "long"), "ngram-several")
    left = labelled.join(hinted(several, several), "h").join(each.select("c", *[_folded(i) for i in range(FOLD)]), "c").join(hinted(heads, multi), "c", "left")
    left = cut(left.withColumn("alone", F.col("members").isNull()).drop("members"), "ngram-open")
    short, long, spans = left.filter("NOT long").drop("long"), left.filter("long").drop("long"), _group_bits(bits, grouped)
    words = [F.array(*[f"{y}{i}" for i in range(WORDS)]).alias(x) for y, x in (("l", "low"), ("h", "high"))]
    posted = spans.select(F.col("head").alias("c"), *words).join(hinted(long.select("c").distinct()), "c", "left_semi")
    long = cut(long.join(posted, "c"), "ngram-long")
    group_pairs = _met(short, percent, False).unionByName(_met(long, percent, True)).distinct()
    inside = mixed.select(F.col("head").alias("ga"), F.col("head").alias("gb"))
    candidates = cut(group_pairs.unionByName(inside), "ngram-grouppairs")
    members = cut(_groups_fit(candidates, spans, percent), "ngram-groupsfit")
    more = _verified(_expanded(members, bits, grouped, roots, percent), named, classes, bits, k, percent)
    final = cut(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "ngram-final")

    # Class roots are hashes; a component's name is the least id in it.
    home = cut(classes.join(final.withColumnRenamed("node", "c"), "c", "left").select("c", "rep", F.coalesce("root", "c").alias("root")), "ngram-home")
    least = home.groupBy("root").agg(F.min("rep").alias("component_id"))
    place = cut(home.join(least, "root").select("c", "component_id"), "ngram-place")
    # Documents without words, and those without an id, would all meet under one key: they go round the join.
    alone = sketch.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = sketch.filter("n > 0 AND doc_id IS NOT NULL").join(place, "c").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component, the one with the least id (null ids last); all columns stay.

    Rows are told apart by id and text: rows that share an id but link to nothing stay, rows without an id take part. Of
    rows that repeat both, one stays; texts without shingles are linked to nothing and stay as they are.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    found = jaccard_components(docs.select(key.alias("__key"), F.col(text_col)), k, percent, "__key", text_col).filter("n_shingles > 0")
    found = cut(found.groupBy(F.col("doc_id").alias("__key"), "component_id").agg(F.count("*").alias("n")), "ngram-found")
    several = found.groupBy("component_id").agg(F.sum("n").alias("rows")).filter("rows > 1").select("component_id")
    several = cut(several, "ngram-linked")
    linked = cut(found.join(hinted(several, several), "component_id"), "ngram-rows")
    ids = docs.select(key.alias("__key"), F.col(id_col).alias("i")).join(hinted(linked, linked), "__key")
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull().alias("unnamed"), "i", "__key")).alias("m")).select(F.col("m.__key").alias("__key"), F.lit(True).alias("__kept"))
    gone = cut(linked.join(kept, "__key", "left").filter("__kept IS NULL OR n > 1").select(F.col("__key").alias("__gone"), F.col("__kept").isNotNull().alias("__kept")), "ngram-gone")
    same = key == F.col("__gone")
    single = docs.join(hinted(gone.select("__gone"), gone), same, "left_anti")
    repeated = gone.filter("__kept").select("__gone")
    if not repeated.head(1):
        return single
    return single.unionByName(docs.join(hinted(repeated, gone), same, "inner").dropDuplicates(["__gone"]).drop("__gone"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the least id that it is linked to."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_aggregate(w, 'string_agg', ' ') AS h FROM w WHERE len(w) BETWEEN 1 AND 2
  UNION ALL
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (h) GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""
