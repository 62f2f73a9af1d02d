"""The command line: python -m recallspark.cli --store FOLDER command ... Each command is one call of MemoryEngine."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, duration_hours, merged
from .functions.text import format_bytes, mask, scrub
from .operators.formatting import hook_output
from .plans.engine import MemoryEngine

#: The environment's variable that names the log's folder where a command does not.
LOG_VARIABLE = "RECALLSPARK_LOG"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recallspark")
    p.add_argument("--store", required=True)
    p.add_argument("--config", help="a JSON file of settings")
    p.add_argument("--as-of", help="the time to count from, in ISO form; now if it is not given")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **kinds: dict) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, **kinds.get(a.strip("-").replace("-", "_"), {}))

    flag, number = {"action": "store_true"}, {"type": int}
    add("save", "stops", "--log", log={"required": True})
    add("capture", "prompts")
    add("recall", "prompt", "--project")
    add("search", "query", "--project", "--limit", limit={"type": int, "default": 50})
    add("resolutions", "query", "--project", "--show-evidence", query={"nargs": "?"}, show_evidence=flag)
    add("edit", "id", "--content", id=number, content={"required": True})
    add("delete", "--session", "--before", "--chunk", chunk=number)
    add("list", "--project")
    add("stats", "--project")
    add("prune", "--older-than", older_than={"required": True})
    add("export", "--markdown", markdown=flag)
    add("merge", "--threshold", "--dry-run", threshold={"type": float, "default": 0.6}, dry_run=flag)
    add("maintain")
    add("recover", "folder")
    add("import-transcripts", "folder", "--project", project={"required": True})
    add("import-foreign", "sessions", "observations", "summaries", "--project", "--dry-run", dry_run=flag)
    add("inject", "--project", "--hook", project={"required": True}, hook=flag)
    add("rebuild", "log", "--dry-run", "--from-month", dry_run=flag)
    add("migrate", "log", "--host", host={"default": "local"})
    add("refresh", "log", log={"nargs": "?"})
    add("compact")
    add("index")
    add("embed", "--dry-run", dry_run=flag)
    return p


def _lines(df, limit: int | None = None) -> list[str]:
    return [r[0] for r in (df if limit is None else df.limit(limit)).select(F.to_json(F.struct(*df.columns))).collect()]


def run(spark: SparkSession, argv: list[str], model=None) -> list[str]:
    """The lines that a command prints. Reports are bounded by their limits; export writes whole sessions. model is the embedding's pandas UDF, which embed needs."""
    a = parser().parse_args(argv)
    settings = {}
    if a.config:
        with open(a.config) as f:
            settings = json.load(f)
    e = MemoryEngine(spark, a.store, merged(Config(), settings))
    now = datetime.fromisoformat(a.as_of) if a.as_of else datetime.now(timezone.utc).replace(tzinfo=None)
    match a.command:
        case "save":
            return _lines(e.save_answers(spark.read.json(a.stops, schema="runtime string, session string, turn_id string, project string, answer string, sequence long, completed_at string, model string"), a.log, now))
        case "capture":
            from .sources.pending import PENDING

            e.capture_prompts(spark.read.json(a.prompts, schema=PENDING))
            return []
        case "recall":
            return [r["text"] for r in e.recall(a.prompt, now, a.project, model=model).collect()]
        case "search":
            return _lines(e.search(a.query, now, a.project, a.limit).select("id", "session", "score", F.substring("content", 1, 200).alias("content")), a.limit)
        case "resolutions":
            d = e.resolutions(a.query, a.project)
            evidence = ["failure_excerpt", "success_excerpt"] if a.show_evidence else []
            return _lines(d.select("project", "session", "failure_count", "verified_at", *[scrub(mask(F.col(c))).alias(c) for c in ["command", *evidence]]))
        case "edit":
            e.edit(a.id, a.content)
            return []
        case "delete":
            tests = [F.col("session") == a.session if a.session else None, F.col("created_at") < F.lit(a.before).cast("timestamp") if a.before else None, F.col("id") == a.chunk if a.chunk is not None else None]
            chosen = [t for t in tests if t is not None]
            if not chosen:
                raise SystemExit("delete needs --session, --before or --chunk")
            e.delete(chosen[0])
            return []
        case "list":
            return _lines(e.sessions(a.project))
        case "stats":
            return _lines(e.stats(a.project).withColumn("size", format_bytes(F.col("bytes"))))
        case "prune":
            e.prune(now, duration_hours(a.older_than) / 24)
            return []
        case "export":
            return [r["line"] for r in e.export(a.markdown).orderBy("session", "chunk_index").toLocalIterator()]
        case "merge":
            return _lines(e.merge(a.threshold, a.dry_run).agg(F.count_distinct("group").alias("groups"), F.count_if(~F.col("keep")).alias("removed")))
        case "maintain":
            return [json.dumps(e.maintain(now))]
        case "recover":
            return _lines(e.recover(a.folder))
        case "import-transcripts":
            return [str(e.import_transcripts(a.folder, a.project).count())]
        case "import-foreign":
            return _lines(e.import_foreign(*[spark.read.parquet(x) for x in (a.sessions, a.observations, a.summaries)], a.project, a.dry_run))
        case "inject":
            d = e.inject(a.project)
            return [r[0] for r in d.select(hook_output(F.col("text"), "SessionStart") if a.hook else F.col("text")).collect()]
        case "rebuild":
            return [str(e.rebuild(a.log, a.dry_run, a.from_month).count())]
        case "refresh":
            where = a.log or os.environ.get(LOG_VARIABLE)
            if not where:
                raise SystemExit(f"refresh needs the log's folder, as an argument or in {LOG_VARIABLE}")
            return [json.dumps(e.refresh(where))]
        case "compact":
            return e.compact(2)
        case "migrate":
            e.migrate(a.log, a.host)
            return []
        case "index":
            e.index()
            return []
        case _:
            if model is None and not a.dry_run:
                raise SystemExit("embed needs a model: call run() with its pandas UDF")
            return [json.dumps(e.backfill(model, a.dry_run))]


if __name__ == "__main__":
    session = SparkSession.builder.appName("recallspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print("\n".join(run(session, sys.argv[1:])))
