"""Relational shapes: latest rows, densifying, paging, range joins, chains, upserts, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut: checkpointed in the shared folder, or kept in the executors where no folder is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df.persist()


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all cores: a small file is one task, however long its rows take."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


# -- latest rows and first rows -------------------------------------------------------------


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first under ``order``. One shuffle on the key, no self join."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_attempt(responses: DataFrame, key: str = "run_item_id") -> DataFrame:
    """Latest eligible response per item: attempt, then creation time, then id."""
    ok = responses.where(~F.coalesce(F.col("ignored_after_cancel"), F.lit(False)))
    return latest_per_key(ok, [key], [F.desc("attempt"), F.desc("created_at"), F.desc("id")])


def copy_forward(revisions: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    """The next revision of every key: its latest row with some columns changed."""
    last = latest_per_key(revisions, [key], [F.desc("revision")])
    return last.withColumns({"revision": F.col("revision") + 1, **changes})


def next_number(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Rows numbered from 1 over the whole table, without a window over all of it.

    Rows are dealt to ranges of the order; each range is numbered by itself and starts behind
    the row counts of the ranges before it, of which there is one row for each.
    """
    dealt = settled(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    begun = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn("__r", inside).join(begun, "__p").withColumn(name, F.col("__s") + F.col("__r")).drop("__p", "__r", "__s")


# -- densifying and totals ------------------------------------------------------------------


def densify(facts: DataFrame, dims: list[list[str]], measures: dict[str, object]) -> DataFrame:
    """All combinations of the distinct values of each dimension group, measures defaulted.

    The dimensions are small by nature (models, modes, purposes); facts are already grouped.
    """
    grid = reduce(DataFrame.crossJoin, [facts.select(*d).distinct() for d in dims])
    keys = [c for d in dims for c in d]
    out = grid.join(facts, keys, "left")
    return out.withColumns({m: F.coalesce(F.col(m), F.lit(v)) for m, v in measures.items() if v is not None})


def page_with_total(df: DataFrame, order: list[Column], page: int, size: int, most: int = 50, total: str = "total") -> DataFrame:
    """A page of rows; the total stays even if the page lies past the end (one row of NULLs)."""
    page, size = max(1, int(page)), min(max(1, int(size)), most)
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return df.agg(F.count(F.lit(1)).alias(total)).join(rows, F.lit(True), "left")


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int, null_as: dict[str, object] | None = None) -> DataFrame:
    """Rows after a tuple of keys, and one more to tell whether there are further ones."""
    filled = [F.coalesce(F.col(k), F.lit((null_as or {}).get(k))) if k in (null_as or {}) else F.col(k) for k in keys]
    if after is not None:
        df = df.where(F.struct(*filled) > F.struct(*[F.lit(x).cast(df.schema[k].dataType) for x, k in zip(after, keys)]))
    return df.orderBy(*filled).limit(size + 1)


def last_then_ascending(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n).orderBy(key)


# -- filters --------------------------------------------------------------------------------


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality (or membership, for lists) on the given columns; None and blanks filter nothing."""
    for name, value in wanted.items():
        if isinstance(value, str):
            value = value.strip() or None
        if value is None:
            continue
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def text_search(df: DataFrame, query: str, fields: list[Column]) -> DataFrame:
    """Rows with the query in any field, whatever its case; % and _ in it are wildcards."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(f.ilike(f"%{query}%"), F.lit(False)) for f in fields]))


def real_approved(questions: DataFrame, revisions: DataFrame, sample_provider: str = "sample", mock: str = "mock-%") -> DataFrame:
    """Approved questions not deleted and without a revision by a sample or mock model."""
    fake = revisions.where((F.col("provider") == sample_provider) | F.col("model_id").like(mock)).select("question_id")
    live = questions.where((F.col("status") == "APPROVED") & F.col("deleted_at").isNull())
    return live.join(fake, live["id"] == fake["question_id"], "left_anti")


# -- range and pattern joins ----------------------------------------------------------------


def preceding_neighbours(hits: DataFrame, rows: DataFrame, group: str, ordinal: str, window: int) -> DataFrame:
    """Rows up to ``window`` places before each hit in its group.

    The range is exploded to the wanted ordinals, so the join is an equi-join.
    """
    wanted = hits.where(F.col(ordinal) > 1).select(
        F.col(group),
        F.col(ordinal).alias("anchor_ordinal"),
        *[c for c in hits.columns if c not in (group, ordinal)],
        F.explode(F.sequence(F.greatest(F.lit(1), F.col(ordinal) - window), F.col(ordinal) - 1)).alias(ordinal),
    )
    return wanted.join(rows, [group, ordinal])


def span_join(spans: DataFrame, points: DataFrame, group: str, start: str, end: str, at: str) -> DataFrame:
    """Points of a group inside [start, end) of its spans; an open end reaches to the last point."""
    p = points.withColumnRenamed(group, "__g")
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return spans.join(p, (F.col(group) == F.col("__g")) & inside).drop("__g")


def price_by_pattern(usage: DataFrame, prices: DataFrame, model: str = "model_id") -> DataFrame:
    """Each usage row with the newest price whose LIKE pattern fits its model, if any."""
    # patterns meet the distinct models only; usage then joins by equality
    fits = usage.select(model).distinct().join(prices, F.expr(f"{model} LIKE model_pattern"))
    best = latest_per_key(fits, [model], [F.desc_nulls_last("valid_from"), F.desc_nulls_last("price_id")])
    return usage.join(best, model, "left")


# -- pointers -------------------------------------------------------------------------------


def resolve_receipts(rows: DataFrame, key: str, root: str, fields: list[str]) -> DataFrame:
    """Light rows that point to a root row take the fields they lack from it."""
    roots = rows.select(F.col(key).alias("__root"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = rows.join(roots, rows[root] == roots["__root"], "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields}).drop("__root", *[f"__{f}" for f in fields])


def follow_pointers(rows: DataFrame, key: str, pointer: str, payload: list[str] | None = None) -> DataFrame:
    """key, root, hops, state of every row, by pointer jumping: ROOT, RESOLVED, DANGLING, CYCLE, or
    INCOMPLETE where the chain ends at a row that lacks one of the ``payload`` columns.

    Each round doubles the distance covered; after as many rounds as a chain of all rows would
    need, what is not resolved is on a cycle or leads into one.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in payload]) if payload else F.lit(True)
    ids = rows.select(F.col(key).alias("k"), F.col(pointer).alias("p"), whole.alias("whole"))
    known = ids.select(F.col("k").alias("p"), F.lit(True).alias("there"))
    at = ids.join(known, "p", "left").select(
        "k",
        F.coalesce("p", "k").alias("to"),
        F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("hops"),
        F.when(F.col("p").isNull(), F.when(F.col("whole"), "ROOT").otherwise("INCOMPLETE")).when(F.col("there").isNull(), "DANGLING").alias("state"),
    )
    # rows that have come to an end leave the rounds; only rows on their way are joined, each with the row it points to
    done = [at.where("state is not null")]
    open_ = at.where("state is null").drop("state")
    ends = done[0]
    for _ in range(rows.count().bit_length() + 1):
        if open_.isEmpty():
            break
        to = lambda df, state: df.select(F.col("k").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), state.alias("state"))
        nxt = to(ends, F.when(F.col("state") == "ROOT", "RESOLVED").otherwise(F.col("state"))).unionByName(to(open_, F.lit(None).cast("string")))
        at = settled(open_.join(nxt, "to").select("k", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), "state"))
        done.append(at.where("state is not null"))
        ends = ends.unionByName(done[-1])
        open_ = at.where("state is null").drop("state")
    at = reduce(DataFrame.unionByName, [*done, open_.withColumn("state", F.lit("CYCLE"))])
    return at.select(
        F.col("k").alias(key),
        F.when(F.col("state").isin("ROOT", "RESOLVED"), F.col("to")).alias("root"),
        F.col("hops"),
        F.coalesce("state", F.lit("CYCLE")).alias("state"),
    )


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, ancestor, distance) for all ancestors, one join per level until no node has a farther one.

    A node that meets itself is on a cycle, which has no closure: ValueError.
    """
    step = nodes.where(F.col(parent).isNotNull()).select(F.col(key), F.col(parent).alias("ancestor"), F.lit(1).alias("distance"))
    up = nodes.where(F.col(parent).isNotNull()).select(F.col(key).alias("ancestor"), F.col(parent).alias("__up"))
    levels, at = [], step
    while not at.isEmpty():
        levels.append(at)
        at = at.join(up, "ancestor").select(key, F.col("__up").alias("ancestor"), F.lit(len(levels) + 1).alias("distance"))
        at = settled(at)
        if not at.where(F.col(key) == F.col("ancestor")).isEmpty():
            raise ValueError("the parents form a cycle")
    return reduce(DataFrame.unionByName, levels) if levels else step


def parent_by_level(entries: DataFrame, group: str, ordinal: str = "ordinal", level: str = "level") -> DataFrame:
    """The nearest earlier entry of a smaller level, by one window per level that occurs."""
    w = Window.partitionBy(group).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(r[0] for r in entries.select(level).where(F.col(level).isNotNull()).distinct().collect())[:-1]
    above = [F.when(F.col(level) > n, F.last(F.when(F.col(level) == n, F.col(ordinal)), ignorenulls=True).over(w)) for n in levels]
    best = F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(None).cast(entries.schema[ordinal].dataType)
    return entries.withColumn("parent_ordinal", best)


def carry_forward(chunks: DataFrame, group: str, ordinal: str = "ordinal") -> DataFrame:
    """Chapter and unit carried to later rows; a change of chapter ends the unit."""
    w = Window.partitionBy(group).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    by = Window.partitionBy(group).orderBy(ordinal)
    a = chunks.withColumn("chapter", F.last("chapter", ignorenulls=True).over(w))
    changed = (~F.col("chapter").eqNullSafe(F.lag("chapter").over(by))).cast("int")
    b = a.withColumn("__run", changed).withColumn("__run", F.sum("__run").over(w))
    inside = Window.partitionBy(group, "__run").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("unit", F.last("unit", ignorenulls=True).over(inside)).drop("__run")


def heading_starts(chunks: DataFrame, group: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows at which chapter or unit differs from the row before."""
    by = Window.partitionBy(group).orderBy(ordinal)
    new = ~F.struct("chapter", "unit").eqNullSafe(F.lag(F.struct("chapter", "unit")).over(by))
    return chunks.withColumn("starts", new).where("starts").drop("starts")


# -- sets and upserts -----------------------------------------------------------------------


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append: one per key, and no key that exists."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def later_deadline_wins(log: DataFrame, key: str, deadline: str, fields: list[str]) -> DataFrame:
    """State after upserting a log: the fields of the latest deadline, and how many hits there were."""
    best = F.max_by(F.struct(deadline, *fields), F.struct(deadline, *fields))
    out = log.groupBy(key).agg(best.alias("__s"), F.count(F.lit(1)).alias("hit_count"))
    return out.select(key, f"__s.{deadline}", *[f"__s.{f}" for f in fields], "hit_count")


def merged_deadlines(state: DataFrame | None, log: DataFrame, key: str, deadline: str, fields: list[str]) -> DataFrame:
    """The state (key, deadline, fields, hit_count) after a further log: the later deadline wins, hits are added."""
    new = later_deadline_wins(log, key, deadline, fields)
    if state is None:
        return new
    both = state.unionByName(new)
    best = F.max_by(F.struct(deadline, *fields), F.struct(deadline, *fields))
    out = both.groupBy(key).agg(best.alias("__s"), F.sum("hit_count").alias("hit_count"))
    return out.select(key, f"__s.{deadline}", *[f"__s.{f}" for f in fields], "hit_count")


def renumbered(df: DataFrame, group: list[str], order: list[Column], number: str = "ordinal") -> DataFrame:
    return df.withColumn(number, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one side only, with the side; empty if the sets are equal."""
    a = left.exceptAll(right).distinct().withColumn("side", F.lit("left_only"))
    b = right.exceptAll(left).distinct().withColumn("side", F.lit("right_only"))
    return a.unionByName(b)


def canonical_blobs(df: DataFrame, content: str, order: list[Column]) -> DataFrame:
    """Every row with the sha256 of its content and whether it is the row that keeps the blob."""
    hashed = df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    w = Window.partitionBy("sha256").orderBy(*order)
    return hashed.withColumn("is_canonical", F.row_number().over(w) == 1)


def hash_collisions(df: DataFrame, content: str) -> DataFrame:
    """Hashes of several contents, told apart by two further hashes, so that contents are not shuffled."""
    raw = F.col(content).cast("binary")
    told = df.select(F.sha2(raw, 256).alias("sha256"), F.xxhash64(raw).alias("a"), F.sha1(raw).alias("b"), F.octet_length(raw).alias("n"))
    return told.distinct().where("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")


def claim_order(items: DataFrame, lanes: DataFrame, blocked: DataFrame, lane: str, order: list[Column]) -> DataFrame:
    """Items each lane may take now: not blocked, in fair order, up to the lane's free places."""
    open_ = items.join(blocked, "provider_key", "left_anti")
    ranked = open_.withColumn("position", F.row_number().over(Window.partitionBy(lane).orderBy(*order)))
    return ranked.join(lanes.select(lane, "free"), lane).where("position <= free").drop("free")


def missing_providers(needed: DataFrame, available: DataFrame, key: str = "provider_key") -> DataFrame:
    return needed.select(key).distinct().join(available.select(key), key, "left_anti")
