"""Analogs, latent states, the ranking model and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.feature_names import feature_columns
from ..operators.features import drop_unpriced
from ..operators import analog_index as I, analogs as K, construct as C, cross, latent as M, latent_dates as LD, ranking_model as R
from ..operators.construct import Branch
from ..operators.extras import cluster_flags
from ..operators.ranks import fifths
from ..plans.staging import new_path, stage
from ..sources import adapters as A
from ..streaming.period_close import close_days
from ..streaming.quote_state import run_quote_state, state_quotes
from ..streaming.valuation import day_snapshots, stream_snapshots
from . import fixtures as X
from .registry import query

LAT = f"""lat AS (SELECT vec_id AS ticker, CAST(vec_id % {A.PERIODS} AS BIGINT) AS date, embedding::DOUBLE[] AS z,
  CASE WHEN vec_id % {A.PERIODS} < {A.PERIODS - 1} THEN label - 4.5::DOUBLE END AS o FROM embeddings),
pool AS (SELECT date, CAST(coalesce(sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_rows FROM (SELECT date, count(o) AS n FROM lat GROUP BY 1))"""
NN = f"""{LAT},
pairs AS (SELECT q.ticker, q.date, h.ticker AS hist_ticker, h.date AS hist_date, h.o, round(list_distance(q.z, h.z), 9) AS distance FROM lat q JOIN pool p ON p.date = q.date AND history_rows >= 250 JOIN lat h ON h.date < q.date AND h.o IS NOT NULL),
nn AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY distance, hist_date, hist_ticker) AS rank FROM pairs QUALIFY rank <= 50)"""


def _latents(spark, sf):
    return stage(A.latents(spark, sf), "latents")


@query("analog_history_sizes", f"WITH {LAT} SELECT * FROM pool")
def analog_history_sizes(spark, sf):
    return K.history_sizes(A.latents(spark, sf))


@query("analog_neighbors", f"WITH {NN} SELECT * EXCLUDE (o) FROM nn", "distance")
def analog_neighbors(spark, sf):
    return K.nearest_earlier(_latents(spark, sf))


@query("analog_neighbors_split", f"WITH {NN} SELECT * EXCLUDE (o) FROM nn", "distance")
def analog_neighbors_split(spark, sf):
    """The same neighbors when every cell is cut into many blocks and salted groups."""
    return K.nearest_earlier(_latents(spark, sf), pivots=5, eras=3, block_rows=40)


@query(
    "analog_statistics",
    f"""WITH {NN}, s AS (SELECT ticker, date, count(*) AS n, avg(distance) AS neighbor_distance_mean, median(distance) AS neighbor_distance_median, min(distance) AS neighbor_distance_min,
avg(o) AS neighbor_avg_future_1m_return, median(o) AS neighbor_median_future_1m_return, avg(o - 0.5) AS neighbor_avg_future_1m_excess_return,
avg((o - 0.5 > 0)::INT) AS neighbor_outperform_1m_rate, avg((o > 0)::INT) AS neighbor_positive_1m_return_rate FROM nn GROUP BY 1, 2)
SELECT l.ticker, l.date, coalesce(n, 0) AS neighbor_count, s.* EXCLUDE (ticker, date, n) FROM lat l LEFT JOIN s ON s.ticker = l.ticker AND s.date = l.date""",
    "neighbor_distance_mean neighbor_distance_median neighbor_distance_min neighbor_avg_future_1m_return neighbor_median_future_1m_return "
    "neighbor_avg_future_1m_excess_return neighbor_outperform_1m_rate neighbor_positive_1m_return_rate",
)
def analog_statistics(spark, sf):
    rows = _latents(spark, sf)
    return K.neighbor_stats(rows, K.nearest_earlier(rows))


PROBES = 60  # of evenly spread vectors in 64 dimensions, neighbors lie in nearly all parts


@query("analog_probe_recall")
def analog_probe_recall(spark, sf):
    """How many of the exact neighbors a search of each row's PROBES closest parts (cell and era) finds."""
    return _recall(spark, sf, PROBES)


def _recall(spark, sf, probes):
    rows = _latents(spark, sf)
    exact = stage(K.nearest_earlier(rows), "exact")
    return K.recall(K.nearest_earlier(rows, probes=probes), exact)


def _panel_latents(spark, sf, k=16):
    f = stage(drop_unpriced(X.labelled(spark, sf)), "features")
    features = feature_columns(f, "state")
    state = M.with_vector(M.state_matrix(f, features), features)
    return M.fit_latents(stage(state, "state"), features, k).transform(state)


@query("panel_latents")
def panel_latents(spark, sf):
    """Components and reconstruction error of every row of the feature panel."""
    return M.flat_components(_panel_latents(spark, sf), 16).select(
        "date", "ticker", *[f"z{i}" for i in range(1, 17)], "reconstruction_error"
    )


@query("panel_latents_walk_forward")
def panel_latents_walk_forward(spark, sf):
    """Scaler and components fitted on rows before 2000 only, applied to all."""
    import datetime as dt

    f = stage(drop_unpriced(X.labelled(spark, sf)), "features")
    features = feature_columns(f, "state")
    day = dt.date(2000, 1, 1)
    state = stage(M.with_vector(M.state_matrix(f, features, day), features), "state")
    model = M.fit_latents(state, features, 8, before=day)
    return M.flat_components(model.transform(state), 8).select(
        "date", "ticker", *[f"z{i}" for i in range(1, 9)], "reconstruction_error"
    )


def _by_date(spark, sf):
    """Feature panel (staged), its state columns, and the model of every date."""
    f = stage(drop_unpriced(X.labelled(spark, sf)), "features")
    features = feature_columns(f, "state")
    return f, features, stage(LD.models_by_date(f, features, 8), "date-models")


@query("panel_latents_by_date")
def panel_latents_by_date(spark, sf):
    """Components and reconstruction error of every row, each by a model of strictly earlier dates."""
    f, features, models = _by_date(spark, sf)
    return M.flat_components(LD.transformed(f, models, features).drop("model_date"), 8)


@query(
    "latents_by_date_check",
    f"""WITH {X.LABELLED}, r AS (SELECT * FROM lab WHERE price IS NOT NULL),
d AS (SELECT date, n AS rows, CAST(coalesce(sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rows_before FROM (SELECT date, count(*) AS n FROM r GROUP BY 1))
SELECT *, true AS uncorrelated, true AS falling FROM d WHERE rows_before >= 250""",
)
def latents_by_date_check(spark, sf):
    """For every date with a model: its rows, those the model has seen, and that the first components of the rows before the
    date, all of which meet its model, are uncorrelated under it and fall in variance."""
    f, features, models = _by_date(spark, sf)
    dates = [r.date for r in models.select("date").orderBy("date").collect()]  # a calendar
    own = LD.transformed(f, models, features).groupBy("date").agg(F.count("*").alias("rows"))
    calendar = F.array(*[F.lit(d) for d in dates]).cast("array<date>")
    asked = f.withColumn("of", F.filter(calendar, lambda d: d > F.col("date")))
    seen = LD.transformed(asked, models, features, by="of")
    judged = LD.judged(seen, 4).withColumnRenamed("model_date", "date")
    whole = models.select("date", F.col("n").alias("rows_before")).join(own, "date").join(judged, "date", "left")
    return whole.select("date", "rows", "rows_before", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("uncorrelated", "falling")])


DIMS = (4, 8, 16, 32)


def _panel_analogs(spark, sf, dims):
    """{dimension: analog statistics of the feature panel} in the space of its first components, all from one fit."""
    full = stage(
        _panel_latents(spark, sf, max(dims)).select("ticker", "date", "z", "future_1m_return", "future_1m_excess_return"),
        "panel-latents",
    )
    out = {}
    for dim in dims:
        out[dim] = I.indexed_stats(M.prefix(full, dim))
    return out


@query(
    "analog_index_check",
    f"""WITH {X.LABELLED}, r AS (SELECT * FROM lab WHERE price IS NOT NULL),
pool AS (SELECT date, coalesce(sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM (SELECT date, count(future_1m_return) AS n FROM r GROUP BY 1))
SELECT CAST(coalesce(sum(least(50, h)) FILTER (h >= 250), 0) AS BIGINT) AS exact_pairs, CAST(coalesce(sum(least(50, h)) FILTER (h >= 250), 0) AS BIGINT) AS indexed_pairs,
true AS recall_holds, true AS only_earlier FROM r JOIN pool ON pool.date = r.date""",
)
def analog_index_check(spark, sf):
    """The cell index as the other queries use it against the exact search, in the panel's space of eight components: as
    many pairs, at least nine tenths of them the same, and none with a later row."""
    rows = stage(_panel_latents(spark, sf, 8).select("ticker", "date", "z", "future_1m_return"), "panel-latents")
    exact, found = stage(K.nearest_earlier(rows), "exact"), stage(I.nearest_indexed(rows), "indexed")
    pairs = found.agg(F.count("*").alias("indexed_pairs"), (F.count_if(F.col("hist_date") >= F.col("date")) == 0).alias("only_earlier"))
    return K.recall(found, exact).crossJoin(pairs).select(  # one row each
        "exact_pairs", "indexed_pairs", (F.coalesce("recall", F.lit(1.0)) >= 0.9).alias("recall_holds"), "only_earlier"
    )


@query("panel_analog_features")
def panel_analog_features(spark, sf):
    """Analog statistics of the feature panel in 4, 8, 16 and 32 dimensions (or as many as there are features)."""
    frames = [df.withColumn("dim", F.lit(dim)) for dim, df in _panel_analogs(spark, sf, DIMS).items()]
    return reduce(DataFrame.unionByName, frames)


@query(
    "panel_analog_counts",
    f"""WITH {X.LABELLED}, r AS (SELECT * FROM lab WHERE price IS NOT NULL),
pool AS (SELECT date, coalesce(sum(n) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM (SELECT date, count(future_1m_return) AS n FROM r GROUP BY 1))
SELECT dim, ticker, r.date, CAST(CASE WHEN h >= 250 THEN least(50, h) ELSE 0 END AS BIGINT) AS neighbor_count
FROM r JOIN pool ON pool.date = r.date CROSS JOIN (VALUES (4::BIGINT), (16::BIGINT)) d(dim)""",
)
def panel_analog_counts(spark, sf):
    """How many analogs every row of the panel has in two of the spaces: all of them, or none below the least history."""
    frames = [df.withColumn("dim", F.lit(dim)) for dim, df in _panel_analogs(spark, sf, (4, 16)).items()]
    return reduce(DataFrame.unionByName, frames).select("dim", "ticker", "date", "neighbor_count")


@query(
    "analog_probe_check",
    f"WITH {NN} SELECT count(*) AS exact_pairs, true AS recall_holds FROM nn",
)
def analog_probe_check(spark, sf):
    """The number of exact pairs, and whether the search of PROBES parts finds at least nine tenths of them."""
    return _recall(spark, sf, PROBES).select("exact_pairs", (F.col("recall") >= 0.9).alias("recall_holds"))


def _vectors(spark, sf):
    e = A.latents(spark, sf).withColumn("x", array_to_vector("z")).drop("z")
    return stage(e, "vectors"), [f"e{i}" for i in range(64)]


@query("embedding_variance")
def embedding_variance(spark, sf):
    rows, names = _vectors(spark, sf)
    return M.fit_latents(rows, names, 16).variance(spark)


@query(
    "embedding_scaler",
    "SELECT 'e'||(i - 1) AS feature, avg(embedding[i]::DOUBLE) AS mean, stddev_samp(embedding[i]::DOUBLE) AS scale FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY 1",
    "mean scale",
)
def embedding_scaler(spark, sf):
    rows, names = _vectors(spark, sf)
    return M.fit_latents(rows, names, 4).scaler_table(spark)


@query(
    "embedding_variance_whole",
    "SELECT 64::BIGINT AS components, 1.0::DOUBLE AS shares, true AS falling, 0.0::DOUBLE AS mean_error, true AS uncorrelated, count(*) AS rows FROM embeddings",
    "shares mean_error",
)
def embedding_variance_whole(spark, sf):
    """With as many components as inputs the shares sum to one, fall, are uncorrelated, and nothing of a row is left over."""
    rows, names = _vectors(spark, sf)
    model = M.fit_latents(rows, names, len(names))
    share = [float(v) for v in model.pca.explainedVariance]
    z = model.transform(rows)
    pairs = [(i, i + 1) for i in range(0, 8)]
    return z.agg(
        F.lit(len(share)).alias("components"),
        F.lit(sum(share)).alias("shares"),
        F.lit(all(a >= b for a, b in zip(share, share[1:]))).alias("falling"),
        F.avg("reconstruction_error").alias("mean_error"),
        reduce(
            lambda a, b: a & b,
            [F.abs(F.corr(F.get("z", F.lit(i)), F.get("z", F.lit(j)))) < 1e-6 for i, j in pairs],
        ).alias("uncorrelated"),
        F.count(F.lit(1)).alias("rows"),
    )


@query("latent_dimension_sweep")
def latent_dimension_sweep(spark, sf):
    """Mean squared length of the state kept at each dimension, all from one fit."""
    rows, names = _vectors(spark, sf)
    frames = [
        df.select(F.lit(d).alias("dim"), F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v).alias("kept"))
        for d, df in M.sweep(rows, names, (4, 8, 16, 32)).items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("dim").agg(F.avg("kept").alias("mean_kept"), F.count(F.lit(1)).alias("rows"))


@query("cluster_summary")
def cluster_summary(spark, sf):
    rows, names = _vectors(spark, sf)
    latents = M.fit_latents(rows, names, 16).transform(rows)
    clustered = M.cluster(latents.select("ticker", "date", "z", "reconstruction_error"))
    return cross.cluster_summary(clustered, "cluster", "reconstruction_error")


@query(
    "cluster_check",
    f"SELECT count(*) AS rows, CAST(count(DISTINCT vec_id % {A.PERIODS}) AS BIGINT) AS dates, 4::BIGINT AS clusters, 0::BIGINT AS misplaced, count(*) AS flags FROM embeddings",
)
def cluster_check(spark, sf):
    """Every row is in exactly one cluster, the one whose centre is nearest."""
    rows, names = _vectors(spark, sf)
    latents = M.fit_latents(rows, names, 16).transform(rows)
    c = cluster_flags(M.cluster(latents.select("ticker", "date", "z"), starts=2), 4)
    return c.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("date").alias("dates"),
        F.countDistinct("cluster").alias("clusters"),
        F.count_if(F.get("dist_cluster", F.col("cluster")) > F.array_min("dist_cluster") + 1e-9).alias("misplaced"),
        F.sum(sum((F.col(f"cluster_{i}") for i in range(4)), F.lit(0))).alias("flags"),
    )


@query(
    "validation_split",
    f"""WITH {X.FEAT}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM feat WHERE future_1m_return IS NOT NULL))
SELECT ticker, f.date, i >= floor(n*0.8) AS is_val FROM feat f JOIN d ON d.date = f.date WHERE future_1m_return IS NOT NULL""",
)
def validation_split(spark, sf):
    f = stage(X.feat(spark, sf).filter("future_1m_return is not null").select("ticker", "date"), "train")
    return R.time_split(f)


def _model_table(spark, sf):
    """The feature panel with the statistics of its analogs, in the space of eight components."""
    f = stage(drop_unpriced(X.labelled(spark, sf)), "features")
    return stage(K.with_neighbor_features(f, _panel_analogs(spark, sf, (8,))[8]), "model-table")


MODEL = {"trees": 40, "depth": 3, "step": 0.1, "patience": 8, "min_train": 36}


def _branches(f):
    return {"base": feature_columns(f, "original_only"), "neighbor": feature_columns(f, "original_plus_neighbors")}


def _scores(spark, sf):
    """Scores of the newest date by the original and the neighbor branch, each trained on all earlier dates."""
    f = _model_table(spark, sf)
    newest = f.agg(F.max("date")).first()[0]
    branches = _branches(f)
    return f, R.fit_and_score(f, branches, [(b, newest) for b in branches], **MODEL)


@query("rank_model_scores")
def rank_model_scores(spark, sf):
    return _scores(spark, sf)[1]


@query("walk_forward_scores")
def walk_forward_scores(spark, sf):
    """Scores of every date that can be scored, by both branches: each by a model that saw earlier dates only."""
    f = _model_table(spark, sf)
    return R.walk_forward(f, _branches(f), cross.scoreable_dates(f), new_path(spark, "rankings"), **MODEL)


@query(
    "walk_forward_check",
    f"""WITH {X.LABELLED}, r AS (SELECT * FROM lab WHERE price IS NOT NULL),
d AS (SELECT date, count(*) AS n, count(future_1m_return) AS labelled, row_number() OVER (ORDER BY date) - 1 AS position FROM r GROUP BY 1)
SELECT branch, date, n AS rows, n AS last_rank, true AS ranks_whole, true AS order_agrees, true AS sees_nothing_later
FROM d CROSS JOIN (VALUES ('base'), ('neighbor')) b(branch) WHERE labelled > 0 AND position >= 36""",
)
def walk_forward_check(spark, sf):
    """Every scoreable date and branch: ranks are whole and follow the scores, and for one date in the middle the scores are
    the same when all later rows are gone and all outcomes not known by then are."""
    f = _model_table(spark, sf)
    dates = [r.date for r in cross.scoreable_dates(f).select("date").orderBy("date").collect()]  # a calendar
    branches = _branches(f)
    short = MODEL | {"trees": 6}
    scores = stage(R.fit_and_score(f, branches, [(b, d) for b in branches for d in dates], **short), "scores")
    middle = dates[len(dates) // 2]
    blind = f.filter(F.col("date") <= middle).withColumn(
        "future_1m_return", F.when(F.col("date") < middle, F.col("future_1m_return"))
    )
    single = R.fit_and_score(blind, branches, [(b, middle) for b in branches], **short)
    again = single.select("branch", "date", "ticker", F.col("ranker_score").alias("again"))
    ordered = Window.partitionBy("branch", "date").orderBy("rank_by_date")
    joined = scores.join(again, ["branch", "date", "ticker"], "left").withColumn("above", F.lag("ranker_score").over(ordered))
    return joined.groupBy("branch", "date").agg(
        F.count("*").alias("rows"),
        F.max("rank_by_date").alias("last_rank"),
        (F.countDistinct("rank_by_date") == F.count("*")).alias("ranks_whole"),
        (F.count_if(F.col("above") < F.col("ranker_score")) == 0).alias("order_agrees"),
        (F.count_if((F.col("date") == middle) & ~F.col("again").eqNullSafe(F.col("ranker_score"))) == 0).alias("sees_nothing_later"),
    )


@query(
    "model_portfolio_check",
    f"""WITH {X.LABELLED}, r AS (SELECT * FROM lab WHERE price IS NOT NULL), n AS (SELECT count(*) AS c FROM r WHERE date = (SELECT max(date) FROM r)),
d AS (SELECT max(date) AS date FROM r) SELECT date, c AS base_rows, c AS neighbor_rows, true AS ranks_whole, true AS order_agrees, 1.0::DOUBLE AS weight FROM n, d""",
    "weight",
)
def model_portfolio_check(spark, sf):
    """Scores of both branches into one portfolio: ranks are whole and follow the scores, weights sum to one."""
    f, scores = _scores(spark, sf)
    scores = stage(scores, "scores")
    with_vol = scores.join(f.select("date", "ticker", "vol_12m"), ["date", "ticker"])
    baskets = [C.branch_basket(with_vol.filter(F.col("branch") == b.name), b) for b in (Branch("base", 20, 0.7), Branch("neighbor", 10, 0.3))]
    weights = C.blend(baskets).groupBy("date").agg(F.sum("final_weight_before_regime").alias("weight"))
    ordered = Window.partitionBy("branch", "date").orderBy("rank_by_date")
    checked = scores.withColumn("above", F.lag("ranker_score").over(ordered))
    per = checked.groupBy("date").agg(
        F.count_if(F.col("branch") == "base").alias("base_rows"),
        F.count_if(F.col("branch") == "neighbor").alias("neighbor_rows"),
        (F.countDistinct("branch", "rank_by_date") == F.count(F.lit(1))).alias("_distinct"),
        (F.max("rank_by_date") * 2 == F.count(F.lit(1))).alias("_top"),
        (F.count_if(F.col("above") < F.col("ranker_score")) == 0).alias("order_agrees"),
    )
    return per.join(weights, "date").select(
        "date", "base_rows", "neighbor_rows", (F.col("_distinct") & F.col("_top")).alias("ranks_whole"), "order_agrees", "weight"
    )


NDCG = f"""{X.FEAT}, lb AS (SELECT date, ticker, ret_6m AS s, row_number() OVER (PARTITION BY date ORDER BY future_1m_return, ticker)::DOUBLE/count(*) OVER (PARTITION BY date) AS share FROM feat WHERE future_1m_return IS NOT NULL),
l AS (SELECT *, CASE WHEN share <= 0.2 THEN 0 WHEN share <= 0.4 THEN 1 WHEN share <= 0.6 THEN 2 WHEN share <= 0.8 THEN 3 ELSE 4 END AS lab FROM lb WHERE s IS NOT NULL),
k AS (SELECT *, pow(2, lab) - 1 AS gain, row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) AS r, row_number() OVER (PARTITION BY date ORDER BY lab DESC) AS best FROM l)"""


@query(
    "ranking_ndcg",
    f"""WITH {NDCG} SELECT date, {", ".join(f"sum(gain/log2(r + 1)) FILTER (r <= {n})/nullif(sum(gain/log2(best + 1)) FILTER (best <= {n}), 0) AS ndcg_{n}" for n in (5, 10, 25))} FROM k GROUP BY 1""",
    "ndcg_5 ndcg_10 ndcg_25",
)
def ranking_ndcg(spark, sf):
    """Quality of 6-month momentum as a ranking of the next month."""
    f = X.feat(spark, sf).select("date", "ticker", "future_1m_return", F.col("ret_6m").alias("ranker_score"))
    return R.ndcg(stage(fifths(f).filter("ranker_score is not null"), "scored"))


@query(
    "stream_closed_days",
    """WITH q AS (SELECT CAST(ts AS DATE) AS date, event_type AS series, value, ts, event_id FROM events)
SELECT date, series, arg_max(value, (ts, event_id)) AS price, count(*) AS ticks FROM q WHERE date < (SELECT max(date) FROM q) GROUP BY 1, 2""",
    "price",
)
def stream_closed_days(spark, sf):
    """Days that the watermark has closed; the newest day is still open and does not appear."""
    return close_days(A.tick_stream(spark, sf))


VALUATION = """WITH q AS (SELECT CAST(ts AS DATE) AS day, 'U'||user_id AS ticker, arg_max(value, (ts, event_id)) AS p FROM events GROUP BY 1, 2),
h AS (SELECT 'U'||o_custkey AS ticker, count(*)::DOUBLE AS shares FROM orders GROUP BY 1),
d AS (SELECT q.day, h.ticker, shares*q.p AS cv, shares*b.p AS pv FROM h JOIN q ON q.ticker = h.ticker LEFT JOIN q b ON b.ticker = q.ticker AND b.day = q.day - 1),
s AS (SELECT day, coalesce(sum(pv), 0) AS previous_close_value, coalesce(sum(cv), 0) AS current_value, 0.0::DOUBLE AS cash_value, count(*) AS stock_positions,
coalesce(arg_min(ticker, (-(cv - pv), ticker)) FILTER (cv - pv IS NOT NULL), 'NONE') AS best_ticker, coalesce(max(cv - pv), 0) AS best_day_pnl,
coalesce(arg_min(ticker, (cv - pv, ticker)) FILTER (cv - pv IS NOT NULL), 'NONE') AS worst_ticker, coalesce(min(cv - pv), 0) AS worst_day_pnl FROM d GROUP BY 1)
SELECT *, (SELECT count(*) FROM h) - stock_positions AS missing_quote_count, current_value - previous_close_value AS day_pnl,
CASE WHEN previous_close_value > 0 THEN (current_value - previous_close_value)/previous_close_value ELSE 0 END AS day_return, 0.0::DOUBLE AS cash_weight FROM s"""
VALUATION_COLUMNS = "previous_close_value current_value cash_value best_day_pnl worst_day_pnl day_pnl day_return cash_weight"


@query("stream_valuation", VALUATION, VALUATION_COLUMNS, 4)
def stream_valuation(spark, sf):
    """A book valued against the quote stream, one snapshot per day."""
    holdings = stage(A.event_book(spark, sf).select("ticker", "shares"), "book")
    return stream_snapshots(A.tick_stream(spark, sf), holdings)


@query("stream_valuation_resumed", VALUATION, VALUATION_COLUMNS, 4)
def stream_valuation_resumed(spark, sf):
    """The same from keyed state: the quotes arrive in three parts, and every part is taken in by a stream that starts anew."""
    holdings = stage(A.event_book(spark, sf).select("ticker", "shares"), "book")
    events = A.load(spark, sf, "events")
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    part = F.floor(F.datediff(F.to_date("ts"), F.lit(first)) * 3 / ((last - first).days + 1))
    inbox, quotes, checkpoint = (new_path(spark, label) for label in ("events-inbox", "quotes", "quote-state"))
    for n in range(3):
        events.filter(part == n).write.mode("append").parquet(inbox)
        run_quote_state(A.ticks(spark.readStream.schema(events.schema).parquet(inbox)), quotes, checkpoint)
    return day_snapshots(stage(state_quotes(spark, quotes), "day-quotes"), holdings)
