"""MinHash near-duplicate classes.

One hash function orders all shingles; a text keeps its ``k`` smallest (bottom-k sketch; a short text keeps its whole
set). Inverted lists of the retained values propose pairs, the sketch of the union estimates their similarity, and
exact Jaccard on full sets decides.

* Equal sets are one class from the start: copies never meet in a list.
* A pair at the threshold shares at least ``required`` retained values but for a chance of at most ``MISSED``; the number
  follows from the threshold (`least_shared`). So only the rarest ``size - required + 1`` values of a sketch, by their count over all texts, need a list (prefix principle). Passages
  and lines that many texts share drop out of the lists without being capped.
* In every list the texts first meet one centre per size band: the one whose values are the most common, which in a
  group of variants is their source. Texts joined that way are never paired with each other.
* Two texts near one centre are compared by what sets them apart from it. If they are linked, then either both are linked
  with the centre, and so connected, or they share such differences: at least half of those of the one, when the other is
  not linked with the centre. So the rarer half of the differences needs lists, and in a group of variants those are
  mostly each text's own. Nothing is paired because it resembles the centre.
* By the triangle inequality a text well inside a centre's reach has no partner outside it. What is left are texts near no
  centre of their list: in short lists they are paired, and those of longer lists are joined by the rarest shingles of
  their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import stage
from .components import components
from .text import columns, digest, shingle_set

WIDTH = 5
PERCENT = 85
K = 64
MISSED = 2e-9  # chance at most that a pair at the threshold shares too few values of a sketch
CENTRE_ESTIMATE = 0.25
SHORT_LIST = 16  # entries that are paired with each other
NEAR_PERCENT = 57  # similarity to a centre from which differences are compared


def least_shared(percent: int, k: int) -> int:
    """Of the ``k`` values of a union's sketch, how many a pair of this similarity has in common but for a chance of ``MISSED``
    (binomial, which is wider than drawing without replacement). 35 of 64 at 85, 30 at 80."""
    tail, c = 0, 0
    while c < k:
        tail += comb(k, c) * percent**c * (100 - percent) ** (k - c)
        if tail > MISSED * 100**k:
            break
        c += 1
    return c


def sketches(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch): size and digest of the whole set, and its ``k`` smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, low = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                keys.append(digest(s))
                low.append(s[:k])
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            values = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "sketch"],
            )

    return columns(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, sketch array<bigint>"
    )


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles): the whole set as packed 8-byte hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(packed, pa.large_binary())], names=["doc_id", "shingles"])

    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, shingles binary")


def estimated(pairs: DataFrame, reps: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs whose similarity, estimated on the sketch of the union, is not far below the one sought."""
    side = lambda name: reps.select(F.col("rep").alias(name), F.col("sketch").alias(f"s_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
    return both.filter(
        F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b"))) >= F.size(union) * F.lit(least)
    ).select("a", "b")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"s{name}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with (set of a, set of b) of every row; equal neighbours share the set of a."""
    last, known = None, None
    for batch in batches:
        rows = []
        for a, sa, sb in zip(batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
            if a != last:
                last, known = a, np.frombuffer(sa.as_buffer(), np.int64)
            rows.append((known, np.frombuffer(sb.as_buffer(), np.int64)))
        yield batch, rows


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb): sizes of the full sets of each pair and of their intersection."""

    def shared(x: np.ndarray, y: np.ndarray) -> int:
        small, large = sorted((x, y), key=len)
        at = np.searchsorted(large, small)
        return int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _decoded(batches):
            counts = [[shared(x, y) for x, y in rows], [len(x) for x, _ in rows], [len(y) for _, y in rows]]
            yield pa.record_batch(
                [batch.column("a"), batch.column("b"), *[pa.array(c, pa.int64()) for c in counts]],
                names=["a", "b", "shared", "na", "nb"],
            )

    return _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint, shared bigint, na bigint, nb bigint")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, e): the shingles that are in one set of the pair only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _decoded(batches):
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in rows]
            ends = np.cumsum([0, *map(len, apart)]).astype(np.int32)
            values = pa.array(np.concatenate(apart) if apart else np.zeros(0, np.int64), pa.int64())
            yield pa.record_batch(
                [batch.column("a"), batch.column("b"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["a", "b", "e"]
            )

    made = _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint, e array<bigint>")
    return made.select("a", "b", F.explode("e").alias("e"))


def _at_least(percent: int) -> Column:
    return F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, counted on the full sets."""
    return measured(pairs, sets).filter(_at_least(percent)).select("a", "b")


def inverted_lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, rep, n, band, weight): the lists in which a text has to be looked for, without those that hold one text."""
    values = reps.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    required = F.greatest(F.lit(1), F.floor(F.col("m") * least_shared(percent, k) / k))
    ranked = (
        values.join(common, "v")
        .groupBy("rep", "n", "m")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_df"), F.sum(F.log2("df")).alias("weight"))
        .withColumn("take", (F.size("by_df") - required + 1).cast("int"))
        .filter("take > 0")
    )
    lists = stage(
        ranked.select(
            F.explode(F.slice("by_df", F.lit(1), F.col("take"))).alias("e"),
            "rep",
            "n",
            "weight",
            F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent))).cast("int").alias("band"),
        ).select("e.v", "rep", "n", "band", "weight"),
        "lists",
    )
    several = lists.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v")
    return stage(lists.join(several, "v"), "lists")


def with_centres(lists: DataFrame) -> DataFrame:
    """(v, level, rep, n, own, centre): every entry under the centre of its own size band and, for pairs with a text of the band
    below, under that band's."""
    centre = (
        lists.groupBy("v", "band")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("c"))
        .select("v", F.col("band").alias("level"), (-F.col("c.r")).alias("centre"))
    )
    entries = lists.select("v", F.col("band").alias("level"), "rep", "n", F.lit(True).alias("own")).unionAll(
        lists.select("v", (F.col("band") - 1).alias("level"), "rep", "n", F.lit(False).alias("own"))
    )
    return entries.join(centre, ["v", "level"])


def by_differences(near: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be linked among the texts near one centre, for centres whose texts are not yet connected.

    ``near`` has (a: centre, b: member, shared, na, nb). With r = (100 - percent) / (100 + percent), x and y are linked if
    |x differs from y| <= r (|x| + |y|); so x, not linked with the centre c, and y share at least
    (|dy| + r (|c| - |y|)) / 2 of y's differences dy from c."""
    comp = lambda key, name: comps.select(F.col("node").alias(key), F.col("component").alias(name))
    placed = (
        near.join(comp("b", "cb"), "b", "left")
        .join(comp("a", "ca"), "a", "left")
        .withColumn("cb", F.coalesce("cb", "b"))
        .withColumn("ca", F.coalesce("ca", "a"))
    )
    mixed = (
        placed.groupBy("a")
        .agg(F.min("cb").alias("lo"), F.max("cb").alias("hi"), F.min("ca").alias("ca"))
        .filter((F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("ca")))
        .select("a")
    )
    members = stage(
        placed.join(mixed, "a").select(
            "a", "b", "na", "nb", F.col("cb").alias("comp"), _at_least(percent).alias("linked")
        ),
        "members",
    )
    apart = stage(differences(members, sets), "apart")
    counted = apart.join(apart.groupBy("a", "e").agg(F.count("*").alias("df")), ["a", "e"])
    ordered = counted.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("by_df"))
    share = (100 - percent) / (100 + percent)
    needed = F.ceil((F.size("by_df") + share * (F.col("na") - F.col("nb"))) / 2 - 1e-9)
    both = stage(ordered.join(members, ["a", "b"]), "ordered")
    size = F.size("by_df")
    taken = F.greatest(size - F.greatest(needed, F.lit(1)) + 1, F.lit(0)).cast("int")
    rare = both.select(
        "a", F.col("b").alias("y"), F.col("comp").alias("cy"), F.col("nb").alias("ny"), F.col("linked").alias("ly"),
        size.alias("sy"), F.posexplode(F.slice("by_df", F.lit(1), taken)).alias("iy", "d"),
    )
    full = both.filter("NOT linked").select(
        "a", F.col("b").alias("x"), F.col("comp").alias("cx"), F.col("nb").alias("nx"),
        size.alias("sx"), F.posexplode("by_df").alias("ix", "d"),
    )
    several = lambda df, *c: df.filter("d.df > 1").select("a", F.col("d.e").alias("e"), *c)
    # what the pair has to share; from the rarest shared difference on, both must have that many
    share_xy = F.ceil((F.col("sx") + F.col("sy") - share * (F.col("nx") + F.col("ny"))) / 2 - 1e-9)
    met = (
        several(rare, "y", "cy", "ny", "ly", "sy", "iy")
        .join(several(full, "x", "cx", "nx", "sx", "ix"), ["a", "e"])
        .filter("x <> y AND cx <> cy AND (ly OR y < x)")
        .filter((F.col("sy") - F.col("iy") >= share_xy) & (F.col("sx") - F.col("ix") >= share_xy))
    )
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def within_lists(
    entries: DataFrame, near: DataFrame, comps: DataFrame, sets: DataFrame, inner: int, percent: int
) -> DataFrame:
    """Pairs that no centre accounts for: one text near no centre of a list, the other not well inside one's reach. Short
    lists are paired; the texts of longer ones, which share a passage that makes up much of each, go by their whole sets."""
    grade = near.select(
        F.col("a").alias("centre"), F.col("b").alias("rep"), F.when(_at_least(inner), 2).otherwise(1).alias("grade")
    )
    placed = stage(
        entries.filter(F.col("centre") != F.col("rep"))
        .join(grade, ["centre", "rep"], "left")
        .filter(F.coalesce("grade", F.lit(0)) < 2)
        .join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("v", "level", "rep", "own", "n", F.col("grade").isNull().alias("far"), F.coalesce("component", "rep").alias("comp")),
        "placed",
    )
    size = placed.groupBy("v", "level").agg(F.count("*").alias("entries"), F.max("far").alias("any_far")).filter("any_far")
    sized = placed.join(size, ["v", "level"])
    short = sized.filter(F.col("entries") <= SHORT_LIST)
    far = short.filter("far").select("v", "level", "rep", "own", "comp", "n")
    other = short.select("v", "level", F.col("rep").alias("b"), F.col("own").alias("o"), F.col("comp").alias("cb"), F.col("n").alias("bn"))
    met = (
        far.join(other, ["v", "level"])
        .filter("rep <> b AND comp <> cb AND (own OR o)")
        .filter(F.least("n", "bn") * 100 >= F.greatest("n", "bn") * percent)
    )
    members = sized.filter(F.col("entries") > SHORT_LIST).groupBy("rep").agg(F.max("far").alias("far"), F.min("comp").alias("comp"))
    return (
        met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
        .unionAll(by_full_sets(stage(members, "members"), sets, percent))
        .distinct()
    )


def by_full_sets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``members`` (rep, far, comp) of which one is far and that may be linked, by the prefix principle on whole
    sets: of two linked sets of sizes n and m, at least percent of the larger is shared, so a shingle among the rarest
    n - percent of n + 1 of each is, and from the rarest one on both still have percent / (100 + percent) of n + m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column("shingles")]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            values = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64), pa.int64())
            yield pa.record_batch(
                [batch.column("rep"), pa.array([len(o) for o in own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)],
                names=["rep", "n", "e"],
            )

    held = members.select("rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "shingles")
    shingles = held.mapInArrow(run, "rep bigint, n bigint, e array<bigint>").select("rep", "n", F.explode("e").alias("e"))
    shingles = stage(shingles, "shingles")
    common = shingles.join(shingles.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1"), "e")
    ordered = common.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("by_df"))
    take = (F.size("by_df") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1).cast("int")
    prefix = stage(
        ordered.withColumn("take", take)
        .filter("take > 0")
        .join(members, "rep")
        .select("rep", "n", "far", "comp", (F.col("n") - F.size("by_df")).alias("alone"), F.posexplode(F.slice("by_df", F.lit(1), F.col("take"))).alias("i", "d"))
        .select("rep", "n", "far", "comp", (F.col("alone") + F.col("i")).alias("i"), "d.e"),
        "prefix",
    )
    other = prefix.select("e", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("far").alias("bf"), F.col("comp").alias("cb"), F.col("i").alias("j"))
    needed = F.ceil((F.col("n") + F.col("bn")) * percent / (100 + percent) - 1e-9)
    met = (
        prefix.join(other, "e")
        .filter("rep < b AND comp <> cb AND (far OR bf)")
        .filter((F.col("n") - F.col("i") >= needed) & (F.col("bn") - F.col("j") >= needed))
        .filter(F.least("n", "bn") * 100 >= F.greatest("n", "bn") * percent)
    )
    return met.select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = K) -> DataFrame:
    """Classes of documents linked by 100 * |A and B| >= percent * |A or B| on distinct shingles of whole texts.

    Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable), kept (the row's own id is
    the component's). Null and blank texts have no shingle and no link. Rows that share a doc_id are one document: their
    texts count as linked, and each row is returned. A row without doc_id is returned with a null component and kept;
    it links nothing. Ties do not arise: ids decide. Other columns are ignored; an empty table gives an empty table."""
    sk = stage(sketches(docs, width, k), "sketches")
    named = sk.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = stage(named.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep"), "member")
    reps = stage(
        named.join(classes, "set_key")
        .filter("doc_id = rep")
        .select("rep", F.col("n_shingles").alias("n"), "set_key", "sketch")
        .dropDuplicates(["set_key"]),
        "reps",
    )
    # an id with several texts ties their classes together
    same_id = (
        member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id", "a")
    )
    tied = member.join(same_id, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")

    lists = inverted_lists(reps, k, percent)
    wanted = lists.select(F.col("rep").alias("doc_id")).distinct()
    sets = stage(full_sets(columns(docs, doc_id="bigint", text="string").join(wanted, "doc_id", "left_semi"), width), "sets")

    entries = stage(with_centres(lists), "entries")
    stars = entries.filter(F.col("centre") != F.col("rep")).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    near = stage(measured(estimated(stars, reps, k, CENTRE_ESTIMATE), sets).filter(_at_least(NEAR_PERCENT)), "near")
    first = stage(near.filter(_at_least(percent)).select("a", "b").unionAll(tied), "links")
    found = components(first)
    left = by_differences(near, found, sets, percent).unionAll(
        within_lists(entries, near, found, sets, NEAR_PERCENT + 100 - percent, percent)
    )
    second = stage(confirmed(estimated(left.distinct(), reps, k, least_shared(percent, k) / k), sets, percent), "links")
    final = components(first.unionAll(second))

    ids = member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component")
    )
    ids = ids.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        sk.select("doc_id", "n_shingles")
        .join(ids, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


# The same classes for DuckDB, by counting all shared shingles.
CLASSES_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT k, doc_id, array_to_string(w[i:least(i + {WIDTH - 1}, len(w))], ' ') AS g
  FROM (SELECT k, doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT k, doc_id, count(*) AS n FROM s GROUP BY k, doc_id),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON p.a = x.k JOIN n y ON p.b = y.k
  WHERE 100 * p.c >= {PERCENT} * (x.n + y.n - p.c)),
pair AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM pair UNION SELECT r.a, t.b FROM reach r JOIN pair t ON r.b = t.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (k) LEFT JOIN least ON least.doc_id = w.doc_id
"""
