"""Log template mining with a fixed-depth prefix tree, exact and in parallel.

A message is masked and split into tokens. Its route is its length plus its first
``depth - 1`` tokens, where a node keeps at most ``max_children`` tokens and sends the
rest to a wildcard. Inside a route it joins the most similar cluster or opens one.

* Routes depend only on which token came first at each node, so they are found with
  one aggregation and one limited window per level, over distinct prefixes.
* Routes are independent. One with a single distinct message needs no ordered work.
  Others are folded in position order, one route inside one task, while they fit.
* A route with more rows than a task should hold is solved by windows of its rows: fold the
  rows that may change a template, check in parallel which others of the window would have,
  add the earliest of those, and repeat until there are none. Rows that change nothing
  cannot influence others, so the fixed point is the sequential result. Slices of the
  route's messages keep what they match between windows and are sent new changes only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.fixed_values import DEPTH, MAX_CHILDREN, SIMILARITY, WILDCARD
from seqwarden.functions.text import mask, same_positions, tokens
from seqwarden.operators.leaves import Matches, changing_rows, fold_sorted
from seqwarden.plans.skew import ROWS_PER_TASK, hot_values, join_hot, order_value, positions_overall
from seqwarden.session import materialize, materialize_at, remove_table, shuffles_removed, tables_of

CANDIDATES_PER_ROUND = 10_000
MESSAGES_PER_SLICE = 50_000
HELD_CHARACTERS = 4 << 20  # of templates that a task puts together before it hands them on
UNKNOWN_KEY = -1


@dataclass(frozen=True)
class Mined:
    """``keys``: the input rows with ``key``. ``templates``: key, template, tokens, size, route."""

    keys: DataFrame
    templates: DataFrame


@dataclass(frozen=True)
class MiningSpec:
    depth: int = DEPTH
    threshold: float = SIMILARITY
    max_children: int = MAX_CHILDREN

    def __post_init__(self) -> None:
        if self.depth < 1:
            raise ValueError(f"depth must be at least 1, got {self.depth}")
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError(f"threshold must be between 0 and 1, got {self.threshold}")


def message_tokens(text: str = "_msg") -> Column:
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def with_message(df: DataFrame, message: str, masked: bool = True) -> DataFrame:
    """Masked tokens as one text: tokens hold no blanks, so the text identifies them."""
    text = F.coalesce(F.col(message).cast("string"), F.lit(""))
    return df.withColumn("_msg", F.array_join(tokens(mask(text) if masked else text), " "))


def prefix_text(depth: int) -> Column:
    """Length and leading tokens of ``_msg``: all that routing looks at."""
    parts = message_tokens()
    n = F.when(F.col("_msg") == "", F.lit(0)).otherwise(F.size(parts))
    head = F.slice(parts, 1, depth - 1) if depth > 1 else F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(n.cast("string")), head), " ")


def _next_node(kept: Column) -> Column:
    child = F.when(kept, F.col("_tok")).otherwise(F.lit(WILDCARD))
    return F.when(F.col("_tok").isNull(), F.col("_leaf")).otherwise(F.concat_ws(" ", "_leaf", child)).alias("_leaf")


def _with_token(routed: DataFrame, level: int) -> DataFrame:
    return routed.withColumn("_tok", F.try_element_at(F.split("_prefix", " "), F.lit(level + 1)))


def route_prefixes(prefixes: DataFrame, spec: MiningSpec) -> DataFrame:
    """``_leaf`` per distinct ``_prefix``, given the first position ``_first`` of each.

    A node keeps a token if it is among its first ``max_children`` and did not come
    after the wildcard itself.
    """
    routed = prefixes.select("_prefix", "_first", F.element_at(F.split("_prefix", " "), 1).alias("_leaf"))
    before = None
    for level in range(1, spec.depth):
        routed, at = materialize_at(_route_level(_with_token(routed, level), spec.max_children), "routes")
        if before:
            remove_table(routed.sparkSession, before)
        before = at
    return routed


def _route_level(routed: DataFrame, max_children: int) -> DataFrame:
    firsts = routed.filter(F.col("_tok").isNotNull()).groupBy("_leaf", "_tok").agg(F.min("_first").alias("_p"))
    node = Window.partitionBy("_leaf")
    # the rank filter also runs before the shuffle, so no task receives all tokens of a large node
    kept = firsts.withColumn("_r", F.row_number().over(node.orderBy("_p"))).filter(F.col("_r") <= max_children)
    wild = F.min(F.when(F.col("_tok") == WILDCARD, F.col("_p"))).over(node)
    kept = kept.withColumn("_wild", wild).filter(F.col("_wild").isNull() | (F.col("_p") <= F.col("_wild")))
    kept = kept.select("_leaf", "_tok", F.lit(True).alias("_kept"))
    joined = routed.join(kept, ["_leaf", "_tok"], "left")
    return joined.select("_prefix", "_first", _next_node(F.col("_kept")))


def distinct_messages(work: DataFrame, spec: MiningSpec) -> DataFrame:
    """Distinct messages with first position ``_first``, row count ``_n`` and what routing looks at."""
    return work.groupBy("_msg").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("_prefix", prefix_text(spec.depth))


def _routed(messages: DataFrame, spec: MiningSpec) -> DataFrame:
    """``messages``, a stored table, with route ``_leaf`` and the distinct messages ``_m`` and rows ``_rows`` of the whole route."""
    prefixes = materialize(
        messages.groupBy("_prefix").agg(
            F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_pm"), F.sum("_n").alias("_pn")
        ),
        "prefixes",
    )
    sizes = [F.sum("_pm").alias("_m"), F.sum("_pn").alias("_rows")]
    routes = route_prefixes(prefixes, spec).select("_prefix", "_leaf")
    sized = routes.join(prefixes.select("_prefix", "_pm", "_pn"), "_prefix")
    per_leaf = sized.groupBy("_leaf").agg(*sizes)
    routes = materialize(routes.join(per_leaf, "_leaf"), "routed")
    # a prefix is one row of ``routes``, so a task's share of them is small and the messages need no sorting
    return messages.join(routes.hint("shuffle_hash"), "_prefix").drop("_prefix")


def routed_messages(work: DataFrame, spec: MiningSpec) -> DataFrame:
    """Distinct messages with first position, row count ``_n`` and route ``_leaf``.

    ``_m`` and ``_rows`` are the distinct messages and rows of the whole route. Messages
    are written once; routes and their sizes come from the far smaller prefix table.
    """
    return _routed(materialize(distinct_messages(work, spec), "messages"), spec)


def _fold_routes(rows: DataFrame, threshold: float) -> DataFrame:
    pos = rows.schema["_pos"].dataType
    schema = T.StructType(
        [
            T.StructField("_leaf", T.StringType()),
            T.StructField("_msg", T.StringType()),
            T.StructField("_from", pos),
            T.StructField("_to", pos),
            T.StructField("_cluster", pos),
            T.StructField("_n", T.LongType()),
        ]
    )
    ordered = rows.select("_leaf", "_msg", "_pos").repartition("_leaf").sortWithinPartitions("_leaf", "_pos")
    return ordered.mapInPandas(fold_sorted(threshold), schema)


def _earliest(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows per route; later ones are looked at again in the next round."""
    rank = F.row_number().over(Window.partitionBy("_leaf").orderBy("_pos"))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


class _LargeRoutes:
    """Routes too large for one task, solved window by window of their rows, with state between the windows.

    A slice of a route's messages is one row of ``state``: its messages, what each of them would meet at the
    templates reached so far, and those templates. A window reaches up to the row where ``batch`` more messages
    first come up that would change a template. Its changing rows are folded by one task of the route, starting from the
    templates; every slice replays only them, and says which other rows of the window would have changed a
    template. The earliest of those join the window's rows until there are none. Then the slices
    roll their state forward, and nothing before the window is looked at again: in all, every change is sent to the
    slices of its route as often as its own window was repeated.
    """

    def __init__(self, rows: DataFrame, messages: DataFrame, threshold: float, batch: int):
        pos = rows.schema["_pos"].dataType.simpleString()
        self.threshold, self.batch = threshold, batch
        self.stretch_schema = f"_leaf string, _msg string, _from {pos}, _to {pos}, _cluster {pos}"
        self.log_schema = f"_leaf string, _log array<struct<_pos:{pos},_msg:string>>"
        self.state_schema = (
            f"_leaf string, _slice int, msgs array<string>, firsts array<{pos}>, best array<int>, equal array<int>, outcome array<int>, "
            f"since array<{pos}>, templates array<string>, opened array<{pos}>"
        )
        self.pos = pos
        # by route and position, so a window reads its own rows
        ordered = rows.select("_leaf", "_msg", "_pos").repartitionByRange("_leaf", "_pos").sortWithinPartitions("_leaf", "_pos")
        self.rows = materialize(ordered, "large")
        slices = materialize(
            messages.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(MESSAGES_PER_SLICE)).cast("int").alias("_slices")), "slices"
        )
        at = F.pmod(F.xxhash64("_msg"), F.col("_slices")).cast("int").alias("_slice")
        sliced = messages.join(slices, "_leaf").select("_leaf", at, F.struct("_first", "_msg").alias("m"))
        listed = sliced.groupBy("_leaf", "_slice").agg(F.array_sort(F.collect_list("m")).alias("m"))  # at most about MESSAGES_PER_SLICE
        unmet = F.transform("m", lambda _: F.lit(-1))
        none = F.array().cast(f"array<{pos}>")
        self.state = materialize(
            listed.select(
                "_leaf", "_slice", F.col("m._msg").alias("msgs"), F.col("m._first").alias("firsts"), unmet.alias("best"), unmet.alias("equal"),
                unmet.alias("outcome"), F.transform("m", lambda _: F.lit(None).cast(pos)).alias("since"),
                F.array().cast("array<string>").alias("templates"), none.alias("opened"),
            ),
            "state",
        )

    def solve(self) -> DataFrame:
        """(_leaf, _msg, _from, _to, _cluster): stretches of positions in which a message joins one cluster."""
        ends = self.state.select("_leaf", F.lit(None).cast(self.pos).alias("_begin")).distinct()  # of the rows done, per route
        done = []
        while True:
            windows = self._windows(ends)
            if windows.isEmpty():
                break
            log = self._agreed_log(windows)
            rolled = self._replay(log, roll=True)
            done.append(rolled.filter("_slice < 0").select("_leaf", "_msg", "_from", "_to", "_cluster").filter("_cluster IS NOT NULL"))
            untouched = self.state.join(log.select("_leaf"), "_leaf", "left_anti")
            self.state = materialize(rolled.filter("_slice >= 0").select(*self.state.columns).unionByName(untouched), "state")
            ends = windows.filter("_end IS NOT NULL").select("_leaf", F.col("_end").alias("_begin"))
        held = self.state.select("_leaf", "opened", F.explode(F.arrays_zip("msgs", "outcome", "since")).alias("m")).filter("m.outcome >= 0")
        last = held.select(
            "_leaf", F.col("m.msgs").alias("_msg"), F.col("m.since").alias("_from"), F.lit(None).cast(self.pos).alias("_to"),
            F.get("opened", F.col("m.outcome")).alias("_cluster"),
        )
        for part in done:
            last = last.unionByName(part)
        return last

    def _windows(self, ends: DataFrame) -> DataFrame:
        """(_leaf, _begin, _end) of each route with rows left; no end means all of them.

        Messages not met so far count: the window ends with the first row of the ``batch``-th.
        """
        each = self.state.join(ends, "_leaf").select("_leaf", "_begin", F.explode(F.arrays_zip("firsts", "outcome")).alias("m"))
        unmet = each.filter("m.outcome < 0 AND (_begin IS NULL OR m.firsts > _begin)").select("_leaf", F.col("m.firsts").alias("_pos"))
        bound = _earliest(unmet, self.batch).groupBy("_leaf").agg(F.max("_pos").alias("_end"), F.count(F.lit(1)).alias("_n"))
        end = F.when(F.col("_n") == self.batch, F.col("_end")).alias("_end")
        return materialize(ends.join(bound, "_leaf", "left").select("_leaf", "_begin", end), "windows")

    def _rows_in(self, windows: DataFrame) -> DataFrame:
        span = windows.agg(F.min("_begin").alias("low"), F.count_if(F.col("_begin").isNull()).alias("open"), F.max("_end").alias("high"), F.count_if(F.col("_end").isNull()).alias("rest")).first()
        rows = self.rows
        if "struct" not in self.pos:
            # bounds of all windows together reach the scan
            rows = rows if span.open else rows.filter(F.col("_pos") > F.lit(span.low).cast(self.pos))
            rows = rows if span.rest else rows.filter(F.col("_pos") <= F.lit(span.high).cast(self.pos))
        inside = "(_begin IS NULL OR _pos > _begin) AND (_end IS NULL OR _pos <= _end)"
        return rows.join(windows, "_leaf").filter(inside).select("_leaf", "_msg", "_pos")

    def _agreed_log(self, windows: DataFrame) -> DataFrame:
        """(_leaf, _log): the rows of each window that change a template, in order."""
        inside = materialize(self._rows_in(windows), "window")
        each = self.state.select("_leaf", F.explode(F.arrays_zip("msgs", "outcome")).alias("m"))
        moving = each.filter("m.outcome < 0").select("_leaf", F.col("m.msgs").alias("_msg"))
        found = inside.join(moving, ["_leaf", "_msg"]).groupBy("_leaf", "_msg").agg(F.min("_pos").alias("_pos"))
        base = self.state.groupBy("_leaf").agg(F.min_by("templates", "_slice").alias("templates"))  # the same in every slice
        candidates = found.select("_leaf", "_msg", "_pos")
        while True:
            gathered = candidates.groupBy("_leaf").agg(F.array_sort(F.collect_list(F.struct("_pos", "_msg"))).alias("_rows"))
            # a window's candidates: at most one row for each of its messages
            log = materialize(gathered.join(base, "_leaf").mapInPandas(_fold_window(self.threshold), self.log_schema), "log")
            stretches = self._replay(log, roll=False)
            met = (F.col("_from").isNull() | (F.col("_pos") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("_pos") < F.col("_to")))
            missed = inside.join(stretches, ["_leaf", "_msg"]).filter(met).groupBy("_leaf", "_msg", "_from").agg(F.min("_pos").alias("_pos"))
            missed = materialize(missed.select("_leaf", "_msg", "_pos"), "missed")
            if missed.isEmpty():
                return log
            entries = log.select("_leaf", F.explode("_log").alias("e")).select("_leaf", "e._msg", "e._pos")
            candidates = entries.unionByName(_earliest(missed, self.batch)).distinct()

    def _replay(self, log: DataFrame, roll: bool) -> DataFrame:
        """Every slice replays its route's log: for a check the stretches without a cluster, to roll on all that ended and the new state."""
        sent = self.state.join(log, "_leaf")
        if not roll:
            return sent.mapInPandas(_replay_window(self.threshold, False), self.stretch_schema)
        both = ", ".join([self.state_schema, *[f for f in self.stretch_schema.split(", ") if not f.startswith("_leaf")]])
        return materialize(sent.mapInPandas(_replay_window(self.threshold, True), both), "rolled")


def _fold_window(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for leaf, rows, templates in zip(batch["_leaf"], batch["_rows"], batch["templates"]):
                kept = changing_rows(threshold, [(r["_msg"], r["_pos"]) for r in rows], list(templates))
                out.append((leaf, [{"_pos": pos, "_msg": m} for m, pos in kept]))
            yield pd.DataFrame(out, columns=["_leaf", "_log"])

    return run


STRETCH_COLUMNS = ["_msg", "_from", "_to", "_cluster"]
STATE_COLUMNS = ["_slice", "msgs", "firsts", "best", "equal", "outcome", "since", "templates", "opened"]


def _replay_window(threshold: float, roll: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                row = dict(zip(batch.columns, row))
                met = Matches(threshold, row["msgs"], row["best"], row["equal"], row["outcome"], row["since"], row["templates"], row["opened"])
                for entry in row["_log"]:
                    met.step(entry["_msg"], entry["_pos"])
                if not roll:
                    out = [(row["_leaf"], *s) for s in met.closed + met.still_open() if s[3] is None]
                    yield pd.DataFrame(out, columns=["_leaf", *STRETCH_COLUMNS], dtype=object)
                    continue
                new = (row["_slice"], row["msgs"], row["firsts"], met.best.tolist(), met.equal.tolist(), met.outcome.tolist(), met.since, met.templates(), met.opened)
                ended = [(row["_leaf"], -1, *[None] * 8, *s) for s in met.closed if s[3] is not None]
                yield pd.DataFrame([(row["_leaf"], *new, *[None] * 4), *ended], columns=["_leaf", *STATE_COLUMNS, *STRETCH_COLUMNS], dtype=object)

    return run


def _solve_large_routes(rows: DataFrame, messages: DataFrame, threshold: float, batch: int) -> DataFrame:
    """Assignments of routes too large for one task, as stretches per message with their numbers of rows."""
    solved = _LargeRoutes(rows, messages, threshold, batch)
    steady = solved.solve()
    inside = (F.col("_pos") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_pos") < F.col("_to")))
    counts = (
        solved.rows.join(steady, ["_leaf", "_msg"]).filter(inside).groupBy("_leaf", "_msg", "_from", "_to", "_cluster").agg(F.count(F.lit(1)).alias("_n"))
    )
    return materialize(counts, "solved")


def _repeated(work: DataFrame, messages: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(_msg, _pos): the rows of these messages, which have ``_n`` rows each.

    Rows are found by a hash of the text, so that only hashes and positions are moved. Another text with a hash of one of the messages
    would make more rows than there are; then, and for messages that are hot, the texts themselves are compared.
    """
    if hot is None:
        hashed = F.xxhash64("_msg").alias("_hash")
        rows, at = materialize_at(work.select(hashed, "_pos").join(messages.select(hashed, "_msg"), "_hash").select("_msg", "_pos"), "again")
        if rows.count() == (messages.agg(F.sum("_n")).first()[0] or 0):
            return rows
        remove_table(work.sparkSession, at)
    return materialize(join_hot(work, messages.select("_msg"), ["_msg"], hot), "again")


def _assignments(work: DataFrame, work_at: str, messages: DataFrame, messages_at: str, hot: DataFrame | None, spec: MiningSpec, rows_per_task: int, batch: int) -> tuple[DataFrame, str]:
    """Stretches ``(_leaf, _msg, _from, _to, _cluster, _n)`` for all non-empty messages, written once, and where.

    The position of a message with one row is known with the message; only rows of the others are found again. The tables ``work`` and
    ``messages`` are removed as soon as nothing needs them, and so are those made here.
    """
    spark = work.sparkSession
    filled = messages.filter(F.col("_msg") != "")
    with tables_of(spark):
        again = _repeated(work, filled.filter("_n > 1").select("_msg", "_n"), hot)
        remove_table(spark, work_at)
        with tables_of(spark):
            routed, _ = materialize_at(_routed(filled, spec), "messages", outlives=True, compression="zstd")
        remove_table(spark, messages_at)
        alone = routed.filter(F.col("_m") == 1).select(
            "_leaf",
            "_msg",
            F.col("_first").alias("_from"),
            F.lit(None).cast(work.schema["_pos"].dataType).alias("_to"),
            F.col("_first").alias("_cluster"),
            "_n",
        )
        shared, large = F.col("_m") > 1, F.col("_rows") > rows_per_task
        some = routed.agg(F.count_if(shared & ~large).alias("fold"), F.count_if(shared & large).alias("large")).first()

        def rows_of(chosen: DataFrame) -> DataFrame:
            once = chosen.filter("_n = 1").select("_leaf", "_msg", F.col("_first").alias("_pos"))
            several = join_hot(again, chosen.filter("_n > 1").select("_msg", "_leaf"), ["_msg"], hot)
            return once.unionByName(several.select("_leaf", "_msg", "_pos"))

        parts = [alone]
        if some.fold:
            parts.append(_fold_routes(rows_of(routed.filter(shared & ~large)), spec.threshold))
        if some.large:
            big = routed.filter(shared & large)
            parts.append(_solve_large_routes(rows_of(big), big, spec.threshold, batch))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return materialize_at(out, "assigned", outlives=True)


TEMPLATE = "key long, template string, size long, route string"


def _shared_tokens(template: str, message: str) -> str:
    """The tokens that both have at the same positions, else the wildcard."""
    return template if template == message else " ".join(a if a == b else WILDCARD for a, b in zip(template.split(" "), message.split(" ")))


def _template_batch(held: dict[int, list]) -> pa.RecordBatch:
    columns = [[key, *own] for key, own in held.items()]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([c[i] for c in columns], t) for i, t in enumerate(types)], ["key", "template", "size", "route"])


def _common_tokens(ordered: bool):
    """Batch function that puts the rows (key, template, size, route) of each key together, or of as many as come before others fill the memory.

    Of rows in the order of keys all of a key become one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, characters = {}, 0
        for batch in batches:
            for key, template, size, route in zip(*(c.to_pylist() for c in batch.columns)):
                if (own := held.get(key)) is not None:
                    own[0] = _shared_tokens(own[0], template)
                    continue
                if characters > HELD_CHARACTERS:
                    yield _template_batch(held)
                    held, characters = {}, 0
                held[key] = [template, size, route]
                characters += len(template) + 100
        if held:
            yield _template_batch(held)

    def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key's rows are handed on together, so none is cut where the memory is full
        key, own, done, characters = None, None, {}, 0
        for batch in batches:
            for at, template, size, route in zip(*(c.to_pylist() for c in batch.columns)):
                if own is not None and at == key:
                    own[0] = _shared_tokens(own[0], template)
                    continue
                if characters > HELD_CHARACTERS:
                    yield _template_batch(done)
                    done, characters = {}, 0
                key, own = at, [template, size, route]
                done[key] = own
                characters += len(template) + 100
        if done:
            yield _template_batch(done)

    return by_key if ordered else run


def _merged_templates(members: DataFrame) -> DataFrame:
    """(key, template, size, route), one row for each key: the token all its messages share at a position, else the wildcard."""
    some = members.mapInArrow(_common_tokens(False), TEMPLATE)
    return some.repartition("key").sortWithinPartitions("key").mapInArrow(_common_tokens(True), TEMPLATE)


def mine_templates(
    df: DataFrame,
    message: str,
    order: Sequence[str],
    spec: MiningSpec = MiningSpec(),
    masked: bool = True,
    mint_empty: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
    candidates_per_round: int = CANDIDATES_PER_ROUND,
) -> Mined:
    """Log key per row and the template vocabulary, as one pass over the rows in ``order`` would give.

    Keys count clusters in the order of their first row. Empty messages match nothing, so
    each opens a cluster of its own unless the threshold is 0; ``mint_empty=False``
    gives them the unknown key instead. The order must be total: rows that share an order value,
    or have none, are refused, since their keys would depend on chance.
    """
    work = with_message(df, message, masked).withColumn("_pos", order_value(df, order))
    # masked once: the written pairs are far smaller than the rows, and repeated texts are stored once
    narrow, narrow_at = materialize_at(work.select("_msg", "_pos"), "work", compression="zstd")
    with shuffles_removed(df.sparkSession):
        unclear = narrow.groupBy("_pos").count().filter("count > 1 OR _pos IS NULL").limit(1).collect()
    if unclear:
        raise ValueError(f"the order {list(order)} is not total: {unclear[0]['count']} rows at {unclear[0]['_pos']}")
    empty = materialize(narrow.filter(F.col("_msg") == "").select("_pos"), "empty")
    messages, messages_at = materialize_at(distinct_messages(narrow, spec), "messages", compression="zstd")
    hot = hot_values(messages.filter((F.col("_n") > rows_per_task) & (F.col("_msg") != "")), ["_msg"], rows_per_task=rows_per_task)
    assigned, assigned_at = _assignments(narrow, narrow_at, messages, messages_at, hot, spec, rows_per_task, candidates_per_round)
    no_route = F.lit(None).cast("string").alias("route")
    clusters = assigned.groupBy("_cluster").agg(no_route, F.sum("_n").alias("size"), F.count(F.lit(1)).alias("_stretches"))
    if mint_empty:
        blank = empty.select(F.col("_pos").alias("_cluster"), F.lit("0").alias("route"), F.lit(1).cast("long").alias("size"))
        if spec.threshold == 0.0:
            blank = empty.groupBy().agg(
                F.min("_pos").alias("_cluster"), F.first(F.lit("0")).alias("route"), F.count(F.lit(1)).alias("size")
            ).filter(F.col("size") > 0)
        clusters = clusters.unionByName(blank.withColumn("_stretches", F.lit(0).cast("long")))
    clusters = materialize(clusters, "clusters")
    numbered = positions_overall(clusters, ["_cluster"], "key", rows_per_task=rows_per_task)
    named = assigned.join(numbered.select("_cluster", "key", "size", "_stretches").hint("shuffle_hash"), "_cluster")
    lookup = materialize(named.select("_msg", "_from", "_to", "key", "size", F.col("_leaf").alias("route"), "_stretches"), "lookup")
    remove_table(df.sparkSession, assigned_at)
    filled = work.filter(F.col("_msg") != "")
    inside = (F.col("_pos") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_pos") < F.col("_to")))
    keys = lookup.select("_msg", "_from", "_to", F.col("key").alias("_key"))
    keyed = join_hot(filled, keys, ["_msg"], hot).filter(inside).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_key").alias("key"))
    blanks = work.filter(F.col("_msg") == "")
    if not mint_empty:
        blanks = blanks.select(*df.columns, F.lit(UNKNOWN_KEY).cast("long").alias("key"))
    elif spec.threshold == 0.0:
        only = numbered.filter(F.col("route") == "0").select("route", "key")  # at most one row
        blanks = blanks.withColumn("route", F.lit("0")).join(only, "route").select(*df.columns, "key")
    else:
        blanks = blanks.join(numbered.select(F.col("_cluster").alias("_pos"), "key"), "_pos").select(*df.columns, "key")
    members = lookup.select("key", F.col("_msg").alias("template"), "size", "route")
    texts = members.filter(lookup["_stretches"] == 1)  # the template of a cluster of one message is the message
    texts = texts.unionByName(_merged_templates(members.filter(lookup["_stretches"] > 1)))
    texts = texts.unionByName(numbered.filter(F.col("route") == "0").select("key", F.lit("").alias("template"), "size", "route"))
    words = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", " "))
    templates = texts.select("key", "template", words.alias("tokens"), "size", "route")
    return Mined(keyed.unionByName(blanks), templates)


def catalogue(keys: DataFrame, key: str = "key") -> DataFrame:
    """Messages per template."""
    return keys.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def _follow(df: DataFrame, templates: DataFrame, depth: int) -> DataFrame:
    """Adds ``_at``: the vocabulary's route of ``_msg``, by the exact child, else the wildcard child; null where neither exists."""
    step = F.split("route", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(step)), lambda n: F.array_join(F.slice(step, F.lit(1), n), " "))
    nodes = materialize(templates.select(F.explode(prefixes).alias("_node")).distinct(), "nodes")
    own = [F.col(f"`{c}`") for c in df.columns]
    out = df.withColumn("_path", F.split(prefix_text(depth), " "))
    out = out.withColumn("_at", F.element_at("_path", 1))
    for level in range(1, depth):
        token = F.try_element_at("_path", F.lit(level + 1))
        out = out.withColumn("_exact", F.concat_ws(" ", "_at", token)).withColumn(
            "_wild", F.concat_ws(" ", "_at", F.lit(WILDCARD))
        )
        out = out.withColumn("_short", token.isNull())
        out = out.join(nodes.select(F.col("_node").alias("_e")), F.col("_exact") == F.col("_e"), "left")
        out = out.join(nodes.select(F.col("_node").alias("_w")), F.col("_wild") == F.col("_w"), "left")
        at = F.when(F.col("_short"), F.col("_at")).otherwise(F.coalesce("_e", "_w"))
        out = out.select(*own, "_path", at.alias("_at"))
    return out.drop("_path")


def _score(tokens_column: str) -> Column:
    """Tokens that agree, then the smaller key."""
    return F.struct(same_positions(F.col(tokens_column), message_tokens()).alias("m"), (-F.col("key")).alias("k"))


def _decided(best: Column, threshold: float) -> Column:
    n = F.size(message_tokens())
    share = F.when(n > 0, best["m"] / n).otherwise(F.lit(0.0))
    return F.coalesce(F.when(best.isNotNull() & (share >= threshold), -best["k"]), F.lit(UNKNOWN_KEY)).cast("long").alias("key")


def apply_templates(
    df: DataFrame, message: str, templates: DataFrame, spec: MiningSpec = MiningSpec(), masked: bool = True, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Key of the best template of a frozen vocabulary, or -1; no template changes.

    Each distinct masked message is routed and compared once, with the templates of its route as
    rows, and its key is joined back. On a stream every row is decided on its own by lookups instead.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    rows = with_message(df, message, masked)
    if df.isStreaming:
        return _applied_by_row(rows, own, templates, spec)
    messages = materialize(rows.groupBy("_msg").agg(F.count(F.lit(1)).alias("_n")), "messages")
    routed = _follow(messages.select("_msg"), templates, spec.depth)
    compared = routed.join(templates.select("route", "key", F.col("tokens").alias("_tokens")), F.col("_at") == F.col("route"))
    best = compared.groupBy("_msg").agg(F.max(_score("_tokens")).alias("_best"))
    known = materialize(best.select("_msg", _decided(F.col("_best"), spec.threshold)).filter(F.col("key") != UNKNOWN_KEY), "decided")
    out = join_hot(rows, known.withColumnRenamed("key", "_key"), ["_msg"], hot_values(messages, ["_msg"], rows_per_task=rows_per_task), "left")
    return out.select(*own, F.coalesce("_key", F.lit(UNKNOWN_KEY)).cast("long").alias("key"))


def _applied_by_row(rows: DataFrame, own: Sequence[Column], templates: DataFrame, spec: MiningSpec) -> DataFrame:
    choices = materialize(
        templates.groupBy(F.col("route").alias("_node")).agg(
            F.array_sort(F.collect_list(F.struct("key", "tokens"))).alias("_choices")
        ),
        "choices",
    )
    out = _follow(rows, templates, spec.depth).join(choices, F.col("_at") == F.col("_node"), "left")
    scored = F.transform(
        "_choices", lambda c: F.struct(same_positions(c["tokens"], message_tokens()).alias("m"), (-c["key"]).alias("k"))
    )
    return out.withColumn("_best", F.array_max(scored)).select(*own, _decided(F.col("_best"), spec.threshold))
