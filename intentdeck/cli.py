"""Five commands over an engine: ingest, find, replay, status, insights."""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass


class UsageError(ValueError):
    pass


@dataclass(frozen=True)
class Command:
    name: str
    text: str = ""
    number: int = 0
    dry_run: bool = False


#: Sub-command -> (operand or None, flag with a number or None, its default).
SHAPES = {"ingest": ("command", None, 0), "find": ("query", "--k", 10), "replay": ("uuid", "--depth", 3), "status": (None, None, 0), "insights": (None, "--clusters", 5)}


def parse(args: list[str]) -> Command:
    if not args:
        raise UsageError("usage: intentdeck <subcommand> [args...]")
    name, *rest = args
    if name not in SHAPES:
        raise UsageError(f"unknown subcommand: {name}")
    operand, flag, number = SHAPES[name]
    text, dry = "", False
    if name == "ingest":
        if not rest:
            raise UsageError("usage: intentdeck ingest <command>")
        return Command(name, " ".join(rest))
    if operand:
        if not rest:
            raise UsageError(f"usage: intentdeck {name} <{operand}>" + (f" [{flag} N]" if flag else ""))
        text, *rest = rest
    while rest:
        head, *rest = rest
        if head == "--dry-run" and name == "replay":
            dry = True
        elif head == flag:
            if not rest:
                raise UsageError(f"{flag} requires a value")
            value, *rest = rest
            if not value.isdigit():
                raise UsageError(f"invalid {flag} value: {value}")
            number = int(value)
        else:
            raise UsageError(f"unknown flag for {name}: {head}")
    return Command(name, text, number, dry)


def run(engine, c: Command) -> str:
    if c.name == "ingest":
        return f"Ingested: {engine.ingest(c.text)}\n"
    if c.name == "find":
        return format_results(engine.find(c.text, c.number))
    if c.name == "replay":
        try:
            uuid.UUID(c.text)
        except ValueError as e:
            raise UsageError(f"invalid uuid: {c.text}") from e
        return format_plan(engine.replay(c.text, c.number))
    if c.name == "status":
        return format_status(*engine.status())
    return format_insights(engine.insights(c.number))


def format_results(rows) -> str:
    if not rows:
        return "No results found.\n"
    return "".join([f"Search results ({len(rows)} found):\n", *[f"  [{k}] {i}  (similarity: {s:.4f})\n" for k, (i, s) in enumerate(rows)]])


def format_plan(rows) -> str:
    if not rows:
        return "Empty replay plan.\n"
    return "".join([f"Replay plan ({len(rows)} steps):\n", *[f"  [{k}] {c}  (id: {i}, deps: {d})\n" for k, (c, i, d) in enumerate(rows)]])


def format_status(nodes: int, edges: int, commands: int, dim: int) -> str:
    return f"Engine status:\n  Nodes:    {nodes}\n  Edges:    {edges}\n  Commands: {commands}\n  Dim:      {dim}\n"


def format_insights(rows) -> str:
    if not rows:
        return "No insights available.\n"
    return "".join([f"Insights ({len(rows)} found):\n", *[f"  [{k}] [{kind}] {text}  (confidence: {conf:.2f})\n" for k, (kind, text, conf) in enumerate(rows)]])


def main() -> int:
    import os

    from pyspark.sql import SparkSession

    from intentdeck.engine import Engine

    try:
        command = parse(sys.argv[1:])
    except UsageError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    print(run(Engine(spark, os.environ.get("INTENTDECK_PATH", "./intents")), command), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
