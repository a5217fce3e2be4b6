"""Sinks with progress of their own, fed from the message store.

The store is the source of every sink: a sink is given the committed slices, each with its
batch id, in order.  A ledger per sink keeps which batches of which run it has had,
committed after each of its writes.  So a sink that fails or comes late takes up where
it stopped, without another being called twice, and a sink that is removed and added
again goes on from its own place.

A sink that dies between its write and the ledger's commit is given that batch once more:
like a ``foreachBatch`` function it should replace what it wrote under a batch id.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley import schemas as S
from parley.sources import folders
from parley.streaming.state import Manifest

Sink = Callable[[DataFrame, int], None]


def progress(spark: SparkSession, ledger_path: str, name: str) -> Manifest:
    """What a sink has had: ``taken[run]`` holds ranges of batches."""
    at = f"{ledger_path}/sink={name}"
    found = [n for n in folders.children(spark, at) if n.endswith(".json") and not n.startswith("_")]
    return Manifest(**json.loads(folders.read_text(spark, f"{at}/{max(found)}"))) if found else Manifest()


def _commit(spark: SparkSession, ledger_path: str, name: str, known: Manifest, batch: tuple[str, int]) -> Manifest | None:
    after = Manifest(version=known.version + 1, taken=known.with_taken([batch]))
    at = f"{ledger_path}/sink={name}"
    if not folders.create_text(spark, f"{at}/{after.version:012d}.json", json.dumps({"version": after.version, "taken": after.taken})):
        return None
    for old in folders.children(spark, at):     # one stays behind, for a reader that has just listed it
        if old.endswith(".json") and not old.startswith("_") and int(old[:-5]) < known.version:
            folders.delete(spark, f"{at}/{old}")
    return after


def waiting(spark: SparkSession, store_path: str, known: Manifest) -> list[tuple[str, int, str]]:
    """(run, batch id, folder) of the store's slices that a sink has not had, by run and batch id.

    Slices that were expired before the sink had them are an error: compaction must not go beyond ``had_by_all``.
    """
    out = []
    for run in folders.runs(spark, store_path):
        found = [(n, p) for n, p in folders.slices(spark, store_path, run) if n >= 0]
        snap = folders.snapshot(spark, store_path, run)
        lost = [n for n in range(snap[0] + 1 if snap else 0) if n not in {n for n, _ in found} and not known.has(run, n)]
        if lost:
            raise ValueError(f"batches {lost[0]} to {lost[-1]} of run {run} were expired before the sink had them")
        out += [(run, n, p) for n, p in found if not known.has(run, n)]
    return out


def deliver(spark: SparkSession, store_path: str, ledger_path: str, name: str, sink: Sink) -> int:
    """Give a sink all that it has not had yet; returns the number of batches.

    An error of the sink ends the delivery and is raised; what it had before stays committed.
    Two deliveries to one sink at a time are not meant; the later commit of a batch is left out.
    """
    known, n = progress(spark, ledger_path, name), 0
    for run, batch, path in waiting(spark, store_path, known):
        sink(spark.read.schema(S.MESSAGE).parquet(path), batch)
        after = _commit(spark, ledger_path, name, known, (run, batch))
        if after is None:
            return n      # another delivery has gone ahead
        known, n = after, n + 1
    return n


def deliver_all(spark: SparkSession, store_path: str, ledger_path: str, sinks: dict[str, Sink]) -> dict[str, Exception]:
    """Feed every sink; an error of one does not keep the others.  Returns the errors by name, and warns of them."""
    failed = {}
    for name, sink in sinks.items():
        try:
            deliver(spark, store_path, ledger_path, name, sink)
        except Exception as e:  # noqa: BLE001  a sink may raise anything; it is tried again with the next batch
            failed[name] = e
            warnings.warn(f"sink {name} failed and will be given its batches again: {e}", RuntimeWarning, stacklevel=2)
    return failed


def had_by_all(spark: SparkSession, ledger_path: str, run: str, names: list[str]) -> int:
    """The last batch of a run up to which every named sink has had all; -1 if none."""
    ends = []
    for name in names:
        first = progress(spark, ledger_path, name).taken.get(run, [])[:1]
        ends.append(first[0][1] if first and first[0][0] == 0 else -1)
    return min(ends, default=-1)
