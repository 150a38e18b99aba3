"""Normalise, weigh, sum, order and explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalise import normalise
from tidemark.operators import products
from tidemark.sources.checkpoints import cut

#: Rows of the score order whose reasons are worded, at least.
REASONS = 20
#: A second reason is named from this share of the first on.
SECOND_REASON = 0.4


def score(candidates: DataFrame, signals: dict[str, DataFrame], weights: dict[str, float], how: dict[str, str] | None = None) -> DataFrame:
    """``request_id, item, cand_pos, score, parts``: the weighted sum of the normalised
    signals; ``parts`` maps a signal to its product, and they add up to the score.

    Signals of weight 0 are not read at all.  All signals join on the request and item,
    so their shuffles agree.
    """
    used = [s for s in signals if weights.get(s, 0.0) != 0.0]
    rows = candidates
    for s in used:
        rows = rows.join(signals[s].select("request_id", "item", F.col("raw").alias(f"raw_{s}")), ["request_id", "item"], "left")
    part = {s: weights[s] * normalise(F.col(f"raw_{s}"), (how or {}).get(s, "minmax")) for s in used}
    rows = rows.select("*", *[p.alias(f"part_{s}") for s, p in part.items()])
    return rows.select(*candidates.columns, total(used).alias("score"), parts(used).alias("parts"))


def total(used: list[str]) -> Column:
    return sum((F.col(f"part_{s}") for s in used[1:]), F.col(f"part_{used[0]}")) if used else F.lit(0.0)


def parts(used: list[str]) -> Column:
    return F.create_map(*[x for s in used for x in (F.lit(s), F.col(f"part_{s}"))]) if used else F.expr("map()").cast("map<string,double>")


def bounded(rows: DataFrame, raws: list[str], like: DataFrame | None = None) -> DataFrame:
    """``rows`` of a few lists with ``lo_`` and ``hi_`` of their columns ``raws``: two
    numbers a list go to every task, and no list is gathered in one for them.  ``like``
    has the same ``raws`` where they cost less to make."""
    if not raws:
        return rows
    ends = (rows if like is None else like).groupBy("request_id").agg(*[f(c).alias(f"{n}_{c}") for c in raws for n, f in (("lo", F.min), ("hi", F.max))])
    return rows.join(F.broadcast(ends), "request_id")


def score_in_place(rows: DataFrame, raws: dict[str, Column], weights: dict[str, float], how: dict[str, str] | None = None, like: DataFrame | None = None) -> DataFrame:
    """``score`` of a few lists whose signals are all columns of the candidate's row, with
    columns ``part_<signal>`` instead of the map: nothing is joined by candidate, and
    only a signal that is ranked has its lists gathered.  ``like`` has rows of the same
    lists from which least and greatest raws cost less to find."""
    used = [s for s in raws if weights.get(s, 0.0) != 0.0]
    how = {s: (how or {}).get(s, "minmax") for s in used}
    made = rows.select("*", *[raws[s].alias(f"raw_{s}") for s in used])
    spans = [s for s in used if how[s] not in ("rank", "none")]
    made = bounded(made, [f"raw_{s}" for s in spans], None if like is None else like.select("request_id", *[raws[s].alias(f"raw_{s}") for s in spans]))
    part = {s: weights[s] * normalise(F.col(f"raw_{s}"), how[s], bounds=None if how[s] in ("rank", "none") else (F.col(f"lo_raw_{s}"), F.col(f"hi_raw_{s}"))) for s in used}
    made = made.select(*rows.columns, *[p.alias(f"part_{s}") for s, p in part.items()])
    return made.select("*", total(used).alias("score"))


def ordered(scored: DataFrame) -> DataFrame:
    """Add ``rank``: score descending, item ascending."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), "item")))


def placed(rows: DataFrame, value: Column, ranges: int, tasks: int, descending: bool = False, by: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """``rows`` of a few lists with ``place``, the exact place of each by ``value`` among the
    known of its list (ties by item, a number; NULL for NULL), and ``known``, how many they are.

    A list is cut into ``ranges`` of about as many rows at approximate quantiles, a value found
    in several ranges by item as well.  A range is ranked by itself, on top of what the ranges
    before it hold, so no list is gathered in one task; the rows are dealt out to ``tasks`` once.
    Without ``by`` all rows are one list.
    """
    parts = [k / ranges for k in range(1, ranges)] or [0.5]
    ends = rows.groupBy(*by).agg(F.array_sort(F.percentile_approx(value, parts)).alias("__ends"), F.min("item").alias("__first"), F.max("item").alias("__last"))
    ends = cut(ends)  # read twice, and quantiles may differ from one run to the next
    at = F.coalesce("__ends", F.array().cast("array<double>"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])

    def ended(before) -> Column:  # how many of the sorted ends are before the value, by halving
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(at)) & before(F.get(at, n + step - 1)), n + step).otherwise(n))

    low = ended(lambda end: end < value)
    high = F.when(value.isNull(), F.size(at)).when(F.get(at, F.col("__low")) == value, ended(lambda end: end <= value)).otherwise(F.col("__low"))
    along = F.coalesce((F.col("item") - F.col("__first")) / (F.col("__last") - F.col("__first") + 1.0), F.lit(0.0))
    met = rows.join(F.broadcast(ends), list(by)) if by else rows.crossJoin(F.broadcast(ends))
    cells = met.withColumn("__low", low).withColumns({"__high": high, "__along": along})
    nth = F.least(F.floor(F.col("__along") * (F.col("__high") - F.col("__low") + 1)), F.col("__high") - F.col("__low"))
    cells = cells.select(*rows.columns, (nth - F.col("__high") if descending else nth + F.col("__low")).alias("__range"))
    whole = Window.partitionBy(*by)
    sizes = cells.groupBy(*by, "__range").agg(F.count(value).alias("__n"))
    sizes = sizes.select(*by, "__range", (F.sum("__n").over(whole.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("known"))
    own = Window.partitionBy(*by, "__range").orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), "item")
    ranked = cells.repartition(tasks, *by, "__range").withColumn("__nth", F.row_number().over(own)).join(F.broadcast(sizes), [*by, "__range"])
    return ranked.select(*rows.columns, F.when(value.isNotNull(), F.col("__before") + F.col("__nth")).alias("place"), "known")


def answer(ranked: DataFrame, exclude: DataFrame | None, limit: int) -> DataFrame:
    """Drop excluded items after ranking, then cut; ranks close up."""
    rows = ranked if exclude is None else ranked.join(exclude.select("request_id", "item"), ["request_id", "item"], "left_anti")
    order = Window.partitionBy("request_id").orderBy("rank")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def head(scored: DataFrame, limit: int) -> DataFrame:
    """``ordered`` of each list's first ``limit``: tasks stop at them before a list is whole."""
    return ordered(scored).where(F.col("rank") <= limit)


def dealt(lists: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of ``lists``, in which ``request_id`` names a list, for every one of
    ``requests(request_id, list_id)`` that has it: requests whose candidates and signals
    agree are scored, ordered and reshaped once.  A row meets its requests in arrays, so that
    what it holds is worked out once and not for each."""
    return products.in_pieces(lists.withColumnRenamed("request_id", "list_id"), requests, on=("list_id",)).drop("list_id")


def answer_of_one(scored: DataFrame, requests: DataFrame, exclude: DataFrame, limit: int) -> DataFrame:
    """``answer`` where all requests share one list, ``scored(item, score)``: none can show
    more than its first ``limit`` and as many as one of them excludes."""
    most = exclude.groupBy("request_id").agg(F.countDistinct("item").alias("n")).agg(F.max("n")).first()[0] or 0
    head = scored.orderBy(F.desc(F.round("score", 9)), "item").limit(limit + most)
    ranked = ordered(head.withColumn("request_id", F.lit(0))).drop("request_id")
    return answer(requests.select("request_id").crossJoin(F.broadcast(ranked)), exclude, limit)


def breakdown(answered: DataFrame) -> DataFrame:
    """``request_id, item, signal, contribution, place``: parts of each shown score, the
    greatest first, then by name."""
    flat = answered.select("request_id", "item", F.explode("parts").alias("signal", "contribution"))
    order = Window.partitionBy("request_id", "item").orderBy(F.desc(F.round("contribution", 9)), "signal")
    return flat.withColumn("place", F.row_number().over(order))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{placeholders}`` replaced; NULL if one is left."""
    text = template
    for name, value in values.items():
        text = F.when(value.isNotNull(), F.replace(text, F.lit("{" + name + "}"), value.cast("string"))).otherwise(text)
    return F.when(~F.rlike(text, F.lit(r"\{[a-z_]+\}")), text)


def reason(words: dict[str, Column]) -> Column:
    """The strongest positive part's sentence, and the second if it is strong enough.
    ``words`` maps a signal to its sentence (NULL for none)."""
    entries = F.transform(F.map_entries("parts"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key")))
    best = F.array_sort(F.filter(entries, lambda e: e["minus"] < 0))
    text = F.create_map(*[x for s, w in words.items() for x in (F.lit(s), w)])
    first, second = F.get(best, F.lit(0)), F.get(best, F.lit(1))
    one, two = F.element_at(text, first["key"]), F.element_at(text, second["key"])
    return F.when(F.coalesce(second["minus"] <= first["minus"] * SECOND_REASON, F.lit(False)) & one.isNotNull() & two.isNotNull(), F.concat_ws(" · ", one, two)).otherwise(one)


def best_seeds(pairs: DataFrame, most: int = 2) -> DataFrame:
    """``request_id, item, seed_pos, value, nth``: the seed items to which a candidate owes
    most, of ``pairs(request_id, seed_pos, item, value)``; ties by place in the seed."""
    order = Window.partitionBy("request_id", "item").orderBy(F.desc(F.round("value", 9)), "seed_pos")
    return pairs.where("value > 0").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("request_id", "item", "seed_pos", "value", "nth")


def typical_gap(candidates: DataFrame, attr: str, sample: int = 200) -> DataFrame:
    """``request_id, gap``: mean absolute difference of an attribute over all pairs of
    the first ``sample`` candidates, from their sorted order: with ``n`` values the
    ``i``-th smallest counts ``2 i - n - 1`` times."""
    rows = candidates.where(F.col("cand_pos") <= sample).where(F.col(attr).isNotNull())
    w = Window.partitionBy("request_id")
    ranked = rows.select("request_id", F.col(attr).cast("double").alias("x"), F.row_number().over(w.orderBy(attr, "item")).alias("i"), F.count("*").over(w).alias("n"))
    return ranked.groupBy("request_id").agg((F.sum(F.col("x") * (2 * F.col("i") - F.col("n") - 1)) / F.nullif(F.max(F.col("n") * (F.col("n") - 1) / 2.0), F.lit(0.0))).alias("gap"))
