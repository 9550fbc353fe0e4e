"""The stages put together: raw events to sessions, to a fitted model, to incidents.

Nulls stay null between stages; each export applies its own default.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqwarden.fixed_values import SESSION_KEYS, TOP_K, WINDOW_WIDTH
from seqwarden.functions.text import log_string
from seqwarden.operators import flatten as fl
from seqwarden.operators import incidents as inc
from seqwarden.operators import model, prepare, quality, sessions, windows
from seqwarden.operators import templates as tm
from seqwarden.plans.skew import ROWS_PER_TASK, positions_overall, profile_keys
from seqwarden.session import materialize
from seqwarden.sources.tables import fingerprint, load_model, require_same_vocabulary, save_model

PLACE = ("source_file", "ordinal")
KEYS = [fl.column_name(k) for k in SESSION_KEYS]
SESSION = ["session_id"]
LOG_COLUMNS = ("eventSource", "eventName", "sourceIPAddress", "userIdentity_arn")


def flat_events(events: DataFrame) -> DataFrame:
    """Pruned flat table of raw events with a parsed time; the profile looks at all events.

    The flat events are written once: fill rates, both splits and their sessions read that table
    and not the JSON.
    """
    flat = materialize(fl.flatten(events, fl.event_schema(events)), "flat")
    data = [c for c in flat.columns if c not in PLACE]
    kept = fl.kept_columns(flat, data) if data else []
    return prepare.with_time(fl.unnest_lists(fl.with_required(flat.select(*PLACE, *kept))))


class StageCounts:
    """Rows of each stage, counted by the first job that runs the stage anyway; no scan of its own."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str) -> DataFrame:
        self.seen[stage] = Observation(stage)
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias("n"))

    def rows(self) -> dict[str, int]:
        """Waits for a stage whose job has not run yet, so ask after the result was stored."""
        return {stage: seen.get["n"] for stage, seen in self.seen.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.rows().items()), "stage string, n long")


def session_tables(
    flat: DataFrame,
    split: prepare.SplitSpec = prepare.SplitSpec(),
    noise: prepare.NoiseSpec | None = prepare.NoiseSpec(),
    rows_per_task: int = ROWS_PER_TASK,
    by_time: bool = True,
    counts: StageCounts | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Training and test events without noise, numbered by session; ids start at 0 in each.

    ``by_time=False`` takes events in the order of the input; without ``noise`` all events stay. With ``counts`` the rows of both parts
    are counted before and after noise is removed.
    """
    order = ["eventTime", *PLACE] if by_time else [*PLACE]
    tables = []
    for name, part in zip(("train", "test"), prepare.split_train_test(flat, split)):
        part = counts.watch(part, name) if counts else part
        part = part if noise is None else prepare.drop_noise(part, noise)
        part = counts.watch(part, f"{name} without noise") if counts else part
        tables.append(sessions.assign_sessions(part, KEYS, order, rows_per_task=rows_per_task))
    return tables[0], tables[1]


def numbered(table: DataFrame, by_time: bool = True, out: str = "row") -> DataFrame:
    """A session table with the 0-based number of each row in output order: by time, or by session as read in input order."""
    order = ["eventTime", "session_id", "seq"] if by_time else ["session_id", "seq"]
    return positions_overall(table, order, out)


def validate(
    train: DataFrame,
    test: DataFrame,
    split: prepare.SplitSpec = prepare.SplitSpec(),
    noise: prepare.NoiseSpec = prepare.NoiseSpec(),
    block_rows: int = quality.BLOCK_ROWS,
    by_time: bool = True,
) -> DataFrame:
    """(split, check, passed, n_bad, detail) of both session tables as they would be exported: shared checks and the split's own rule."""
    cols = quality.Columns(ordinal="row")
    shared = quality.shared_checks(cols, noise, block_rows)
    results = []
    for name, table, own in (
        ("train", train, lambda df: quality.check_train_split(df, split, cols)),
        ("test", test, lambda df: quality.check_test_split(df, split, cols)),
    ):
        # filled with the sentinel as on export; written once, and each check reads only its columns
        stored = materialize(prepare.fill_missing(numbered(table, by_time).drop(*PLACE), keep=("session_id", "seq", "row")), "checked")
        results.append(quality.run_checks(stored, [*shared, own], name))
    return results[0].unionByName(results[1])


def for_export(table: DataFrame) -> DataFrame:
    """Session table with the null sentinel, in output order."""
    filled = prepare.fill_missing(table, keep=(*PLACE, "session_id", "seq"))
    return sessions.order_for_output(filled, "eventTime")


def with_log_text(table: DataFrame) -> DataFrame:
    return table.withColumn("message", log_string(*LOG_COLUMNS))


@dataclass(frozen=True)
class Fitted:
    templates: DataFrame
    counts: DataFrame
    meta: dict


def fit(
    train: DataFrame, width: int = WINDOW_WIDTH, spec: tm.MiningSpec = tm.MiningSpec(), backoff: bool = True, test: DataFrame | None = None
) -> Fitted:
    """Templates and next-key counts of the training sessions, in session order.

    Refuses rows that a ``split`` column does not mark as training rows, and rows that are in ``test`` too.
    """
    if "split" in train.columns:
        prepare.require_training_only(train)
    if test is not None and prepare.leaked_rows(train, test, PLACE).limit(1).count():
        raise ValueError("training rows are also in the test set")
    logs = with_log_text(train).select(*SESSION, "seq", "message")
    mined = tm.mine_templates(logs, "message", [*SESSION, "seq"], spec)
    templates = materialize(mined.templates, "templates")
    keys = materialize(mined.keys.select(*SESSION, "seq", "key"), "keys")
    samples = windows.context_windows(keys, SESSION, "seq", "key", width, profile_keys(keys, SESSION))
    counts = model.count_model(samples, "key")
    counts = materialize(model.with_suffixes(counts) if backoff else counts, "counts")
    meta = {"num_keys": templates.count(), "window_size": width, "vocab_fingerprint": fingerprint(templates), "backoff": backoff}
    return Fitted(templates, counts, meta | {f.name: getattr(spec, f.name) for f in fields(spec)})


def mining_spec(fitted: Fitted, given: tm.MiningSpec | None) -> tm.MiningSpec:
    """The parameters that the templates were mined with; others would send messages along other routes."""
    usual = tm.MiningSpec()  # for models stored before the parameters were
    stored = tm.MiningSpec(**{f.name: fitted.meta.get(f.name, getattr(usual, f.name)) for f in fields(usual)})
    if given is not None and given != stored:
        raise ValueError(f"templates were mined with {stored}, given {given}")
    return stored


def save(fitted: Fitted, path: str) -> None:
    save_model(fitted.counts, fitted.meta, f"{path}/model")
    fitted.templates.write.parquet(f"{path}/templates")


def load(spark, path: str) -> Fitted:
    """Stored model and vocabulary; refuses a pair that does not belong together."""
    counts, meta = load_model(spark, f"{path}/model")
    templates = spark.read.parquet(f"{path}/templates")
    require_same_vocabulary(meta, templates)
    return Fitted(templates, counts, meta)


def resume(fitted: Fitted, more: DataFrame, spec: tm.MiningSpec | None = None) -> Fitted:
    """Add the counts of further training sessions under the same vocabulary.

    A message without a template may stand in a context, but is never learned as an expected next key.
    """
    require_same_vocabulary(fitted.meta, fitted.templates)
    spec = mining_spec(fitted, spec)
    keys = tm.apply_templates(with_log_text(more).select(*SESSION, "seq", "message"), "message", fitted.templates, spec)
    samples = windows.context_windows(keys, SESSION, "seq", "key", fitted.meta["window_size"], profile_keys(keys, SESSION))
    counts = model.count_model(samples.filter(F.col("key") >= 0), "key")
    merged = model.merge_models(fitted.counts, model.with_suffixes(counts) if fitted.meta.get("backoff", True) else counts)
    return Fitted(fitted.templates, materialize(merged, "counts"), fitted.meta | {"epoch": fitted.meta.get("epoch", 0) + 1})


def flag_sessions(test: DataFrame, fitted: Fitted, k: int = TOP_K, spec: tm.MiningSpec | None = None) -> DataFrame:
    """Every test event with key, flag and context. A message the vocabulary does not know has key -1 and is flagged."""
    require_same_vocabulary(fitted.meta, fitted.templates)
    spec = mining_spec(fitted, spec)
    keyed = tm.apply_templates(with_log_text(test), "message", fitted.templates, spec)
    keyed = materialize(
        keyed.select(
            *SESSION, "seq", "key", F.date_format("eventTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"),
            F.col("sourceIPAddress").alias("source_ip"), F.col("userIdentity_arn").alias("user_arn"), F.col("eventName").alias("event_name"),
        ),
        "keyed",
    )
    model.check_key_range(keyed, "key", fitted.meta["num_keys"])
    flags = model.detect(
        keyed, fitted.counts, SESSION, "seq", "key", fitted.meta["window_size"], k, fitted.meta.get("backoff", True),
        profile_keys(keyed, SESSION), fitted.meta["num_keys"], all_rows=True,
    )
    return materialize(flags.drop("ctx"), "flags")


def incident_reports(flags: DataFrame, fitted: Fitted) -> DataFrame:
    """Incidents with prompt and report texts; no rows when nothing is flagged."""
    table = inc.incidents(flags, fitted.templates, SESSION)
    texts = inc.with_texts(table, SESSION).drop("is_last_page")
    return table.join(texts, [*SESSION, "page"])
