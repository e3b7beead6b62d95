"""One screening run: frame, guard, gates, ledger, leak register, snapshots, report."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.thresholds import TARGET_TYPES
from ..operators.folds import Folds, load_folds
from ..operators.leakage import SIGNAL
from ..operators.report import LIMITS, drop_rate_by_rule
from ..sources import ingest
from ..sources.scratch import exists, read_text, write_text

VERDICTS = tuple("drop engineer keep leak-suspect redundant review structural-drop".split())
LEDGER = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("column", "semantic_type", "verdict", "metric_name")]
    + [T.StructField("effect", T.DoubleType()), T.StructField("effect_ci", T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))]
    + [T.StructField(c, T.DoubleType()) for c in ("q_value", "shadow_floor", "shape_gap", "fold_spread")]
    + [T.StructField(c, T.StringType()) for c in ("redundant_with", "leak_flag", "reason")]
    + [T.StructField("rank_within_type", T.IntegerType()), T.StructField("power_flag", T.StringType())]
)


class GateFailure(Exception):
    def __init__(self, part: str, failed: list[str]):
        super().__init__(f"part {part}: {'; '.join(failed)}")
        self.part, self.reasons = part, failed


@dataclass(frozen=True)
class Frame:
    """What Part A decides."""

    date_col: str | None = None
    event_col: str | None = None
    grain: str | None = None
    id_cols: tuple[str, ...] = ()
    prevalence: float | None = None
    reference_date: str | None = None
    row_key: str | None = None
    seed: int = 42
    strictness_tier: str | None = None
    target: str | None = None
    target_type: str | None = None


@dataclass
class Ledger:
    """A row for each column; extra fields are allowed and come last."""

    rows: dict[str, dict] = field(default_factory=dict)

    def upsert(self, column: str, **fields) -> None:
        if fields.get("verdict", VERDICTS[0]) not in VERDICTS:
            raise ValueError(f"unknown verdict {fields['verdict']!r}")
        self.rows.setdefault(column, {}).update(fields)

    def get(self, column) -> dict:
        return {"column": column, **self.rows[column]} if column in self.rows else {}

    def frame(self, spark: SparkSession) -> DataFrame:
        """The 15 fixed fields in order, then the extra ones as strings."""
        extra = list(dict.fromkeys(k for r in self.rows.values() for k in r if k not in LEDGER.names))
        schema = T.StructType(LEDGER.fields + [T.StructField(k, T.StringType()) for k in extra])

        def cell(f: T.StructField, v):
            if v is None or f.name == "effect_ci":
                return v
            if isinstance(f.dataType, T.DoubleType):
                return None if v != v else float(v)
            return str(v) if isinstance(f.dataType, T.StringType) else int(v)

        return spark.createDataFrame([tuple(cell(f, {"column": c, **r}.get(f.name)) for f in schema) for c, r in self.rows.items()], schema)


class LeakRegister:
    def __init__(self, rows: list[tuple] = ()):
        self.rows = list(rows)

    def add(self, part, column, detector, ltype, evidence="") -> None:
        self.rows.append((*map(str, (part, column, detector, ltype, evidence)),))

    def extend(self, signals: DataFrame) -> None:
        """Detectors give a row for each suspect column at most."""
        self.rows += [tuple(r) for r in signals.select("part", "column", "detector", "ltype", "evidence").orderBy("column").collect()]

    def for_column(self, column: str) -> list[tuple]:
        return [r for r in self.rows if r[1] == column]

    def signals(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*r, i) for i, r in enumerate(self.rows)], SIGNAL + ", seq int")

    def __len__(self) -> int:
        return len(self.rows)


class Report:
    """Sections by title, written at once; adding a title again replaces its section in place."""

    def __init__(self, spark: SparkSession, path: str, title: str):
        """path: without suffix."""
        self.spark, self.path, self.title, self.sections = spark, path, title, {}
        if exists(spark, f"{path}.json"):
            self.sections = json.loads(read_text(spark, f"{path}.json"))
        self._flush()

    def add(self, title: str, body: str = "", facts: dict | None = None, tables: list[tuple[str, DataFrame]] = (), notes: str | list[str] = (), rows: int = 200) -> None:
        parts = [body] if body else []
        if facts:
            parts.append(_markdown(["field", "value"], list(facts.items())))
        for note in [notes] if isinstance(notes, str) else notes:
            parts.append("\n".join(f"> {line}" for line in str(note).splitlines() or [""]))
        for caption, df in tables:
            some = df.limit(rows + 1).collect()
            more = f"\n\nOnly the first {rows} rows are shown." if len(some) > rows else ""
            parts.append((caption and f"**{caption}**\n\n") + _markdown(df.columns, some[:rows]) + more)
        self.sections[title] = "\n\n".join(parts)
        self._flush()

    def text(self) -> str:
        return "\n\n".join([f"# {self.title}", *[f"## {t}\n\n{b}" for t, b in self.sections.items()]]) + "\n"

    def _flush(self) -> None:
        write_text(self.spark, f"{self.path}.md", self.text())
        write_text(self.spark, f"{self.path}.json", json.dumps(self.sections))

    def export_html(self, path: str | None = None) -> str:
        import html

        out = path or f"{self.path}.html"
        body = "\n".join(f"<h2>{html.escape(t)}</h2>\n<pre>{html.escape(b)}</pre>" for t, b in self.sections.items())
        write_text(self.spark, out, f'<!doctype html><meta charset="utf-8"><title>{html.escape(self.title)}</title><h1>{html.escape(self.title)}</h1>\n{body}\n')
        return out


def _six() -> str:
    return uuid.uuid4().hex[:6]


def _show(v) -> str:
    if v is None or v != v:
        return ""
    return f"{v:.4g}" if isinstance(v, float) else " ".join(str(v).splitlines()).replace("|", "\\|")


def _markdown(head: list[str], rows: list) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(map(str, head)), line(["---"] * len(head)), *[line(map(_show, r)) for r in rows]])


@dataclass
class Run:
    spark: SparkSession
    df: DataFrame
    frame: Frame
    run_id: str
    home: str  # a folder on a file system that all executors share; any URL that Spark can write to
    ledger: Ledger = field(default_factory=Ledger)
    leaks: LeakRegister = field(default_factory=LeakRegister)
    folds: Folds | None = None
    state: dict = field(default_factory=dict)

    def __post_init__(self):
        self.report = Report(self.spark, f"{self.home}/report", f"Column screening, run {self.run_id}")

    def decide(self, **facts) -> None:
        self.frame = replace(self.frame, **facts)

    def guard(self, what: str) -> Folds:
        """No statistic of a column against the target before the folds are frozen."""
        if self.folds is None:
            raise GateFailure(what, ["folds are not frozen, so the target must not be read"])
        return self.folds

    def freeze(self, folds: Folds) -> Folds:
        folds.save(f"{self.home}/folds")
        self.folds = load_folds(self.spark, f"{self.home}/folds")
        return self.folds

    def gate(self, part, conditions, notes=()) -> bool:
        """Writes a card, then raises unless there are conditions and all hold."""
        failed = [k for k, ok in conditions.items() if not ok] if conditions else ["no conditions"]
        card = {"part": part, "conditions": {k: bool(v) for k, v in conditions.items()}, "passed": not failed, "notes": list(notes)}
        write_text(self.spark, f"{self.home}/decision_cards/{part}.json", json.dumps(card, indent=1))
        if failed:
            raise GateFailure(part, failed)
        return True

    def save_ledger(self, name="ledger.parquet") -> str:
        """CSV gets the ends of the interval as columns of their own."""
        out, path = self.ledger.frame(self.spark), f"{self.home}/{name}"
        if name.lower().endswith(".csv"):
            flat = out.select(*[F.col("effect_ci.lo").alias("effect_lo") if c == "effect_ci" else F.col(c) for c in out.columns], F.col("effect_ci.hi").alias("effect_hi"))
            flat.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        else:
            out.coalesce(1).write.mode("overwrite").parquet(path)
        return path

    def checkpoint(self, part: str = "run") -> str:
        """The table as a Parquet snapshot of this part, which is never changed later, and the rest as JSON."""
        table = f"part_{part}-{_six()}"
        self.df.write.parquet(f"{self.home}/{table}")
        self.df = self.spark.read.parquet(f"{self.home}/{table}")
        state = {"frame": asdict(self.frame), "table": table, "state": self.state, "ledger": self.ledger.rows, "leaks": self.leaks.rows, "folds": self.folds is not None}
        write_text(self.spark, f"{self.home}/state.json", json.dumps(state, indent=1))
        return f"{self.home}/state.json"

    def manifest(self) -> dict:
        conf = {k: self.spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")}
        found = {"run_id": self.run_id, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "seed": self.frame.seed, "frame": asdict(self.frame), "spark": self.spark.version, "pyspark": pyspark.__version__, "conf": conf}
        write_text(self.spark, f"{self.home}/manifest.json", json.dumps(found, indent=1))
        return found

    def log(self, path: str | None = None) -> dict:
        """This run's counts by verdict and rule; appended to a file of JSON lines if path is given."""
        verdicts = {}
        for r in self.ledger.rows.values():
            if r.get("verdict"):
                verdicts[r["verdict"]] = verdicts.get(r["verdict"], 0) + 1
        record = {"run_id": self.run_id, "n_columns": len(self.ledger.rows), "verdicts": verdicts, "rules": {r["rule"]: r["n"] for r in drop_rate_by_rule(self.ledger.frame(self.spark)).collect()}}
        if path:
            before = read_text(self.spark, path) if exists(self.spark, path) else ""
            write_text(self.spark, path, before + json.dumps(record) + "\n")
        return record

    def limits_note(self) -> str:
        return LIMITS


def _checked(df: DataFrame, frame: Frame) -> None:
    if frame.target_type is not None and frame.target_type not in TARGET_TYPES:
        raise ValueError(f"{frame.target_type!r} is not a target type: {', '.join(TARGET_TYPES)}")
    for c in (frame.target, frame.event_col, frame.date_col, frame.reference_date, *frame.id_cols):
        if c is not None and c not in df.columns:
            raise ValueError(f"there is no column {c!r}; columns: {', '.join(df.columns)}")


def open_run(spark: SparkSession, source: str | DataFrame, runs_dir: str = "runs", run_id: str | None = None, **frame) -> Run:
    """Read and normalise the table, add a row key and make the run's folder."""
    df = source if isinstance(source, DataFrame) else ingest.read(spark, source)
    frame = Frame(**{k: tuple(v) if k == "id_cols" else v for k, v in frame.items()})
    _checked(df, frame)
    df = ingest.normalise(df)
    if "row_key" not in df.columns:
        df = ingest.with_row_key(df, frame.row_key)
    run_id = run_id or f"{datetime.now(UTC):%Y%m%d-%H%M%S}-{_six()}"
    return Run(spark, df, frame, run_id, f"{runs_dir.rstrip('/')}/{run_id}")


def resume_run(spark: SparkSession, run_id: str, runs_dir: str = "runs") -> Run:
    home = f"{runs_dir.rstrip('/')}/{run_id}"
    if not exists(spark, f"{home}/state.json"):
        raise FileNotFoundError(f"{home} has no checkpoint; open the run and call checkpoint() first")
    s = json.loads(read_text(spark, f"{home}/state.json"))
    frame = Frame(**{k: tuple(v) if k == "id_cols" else v for k, v in s["frame"].items()})
    run = Run(spark, spark.read.parquet(f"{home}/{s['table']}"), frame, run_id, home, Ledger(s["ledger"]), LeakRegister([tuple(r) for r in s["leaks"]]), None, s["state"])
    if s["folds"]:
        run.folds = load_folds(spark, f"{home}/folds")
    return run


def target_column(run: Run) -> Column:
    """The target as the metrics want it: 0 and 1, a number, or a class name."""
    from ..functions.columns import number
    from ..operators.profile import _text, binary01

    if run.frame.target_type == "binary":
        return binary01(run.df, run.frame.target)
    return _text(run.df, run.frame.target) if run.frame.target_type == "multiclass" else number(run.frame.target)
