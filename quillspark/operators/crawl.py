"""Crawling a citation network from seeds by sources in turn, level by level, with failures, counters and a state to resume from."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import crawl_doi
from ..providers import NotSupportedError
from ..sources.tables import shared_dir, there, written

TITLE = "Unknown Title"
DONE, FULL = "completed", "max_papers_reached"


@dataclass
class State:
    """A crawl as it stands: tables of nodes (doi, depth, is_seed, title), edges and failures (doi, reason), and its counters."""

    nodes: DataFrame
    edges: DataFrame
    failed: DataFrame
    depth: int = 0
    status: str = "running"
    hits: dict[str, int] = field(default_factory=dict)
    dropped: int = 0


def seed_nodes(seeds: DataFrame) -> DataFrame:
    """Nodes of seeds (seed) of any form: valid DOIs, once each, at depth 0."""
    doi = crawl_doi(F.col("seed"))
    return seeds.select(doi.alias("doi")).where("doi is not null").distinct().select("doi", F.lit(0).alias("depth"), F.lit(True).alias("is_seed"), F.lit(TITLE).alias("title"))


def _asked(front: DataFrame, chain: list[str], sources: dict, method: str, failed: DataFrame) -> tuple[DataFrame | None, dict[str, int], int]:
    """What the first source of the chain that has anything says of each DOI of front: (source_doi, target_doi); and counts."""
    out, left, hits, dropped = None, front, {}, 0
    end = "source_doi" if method == "references" else "target_doi"
    for name in chain:
        source = sources.get(name)
        if source is None:
            continue
        asked = left.join(failed.select("doi"), "doi", "left_anti")
        try:
            rows = written(getattr(source, method)(asked).select("source_doi", "target_doi").distinct(), "crawl-found")
        except NotSupportedError:
            continue
        answered = rows.select(F.col(end).alias("doi")).distinct()
        hits[name] = answered.count()
        dropped += source.dropped(asked, method)
        out = rows if out is None else out.union(rows)
        left = asked.join(answered, "doi", "left_anti")
    return out, hits, dropped


def expand(state: State, sources: dict, references: list[str], citations: list[str], backward: int, forward: int, most: int | None = None, direction: str = "both") -> State:
    """The state one level on: what the nodes of the last level refer to, and what refers to them.

    Edges count even where their other end isn't admitted, as `most` nodes are there; those of a level are
    admitted by the order of their DOI.
    """
    if direction not in ("both", "backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    front = state.nodes.where(F.col("depth") == state.depth).select("doi")
    names = None
    for name in dict.fromkeys([*references, *citations]):
        if name in sources:
            said = sources[name].metadata(front).select("doi", F.col("title").alias("said"))
            names = said if names is None else names.join(said.withColumnRenamed("said", "more"), "doi", "full").select("doi", F.coalesce(F.nullif("said", F.lit(TITLE)), "more").alias("said"))
    failures = [sources[n].failures(front) for n in dict.fromkeys([*references, *citations]) if n in sources]
    failed = state.failed
    for f in failures:
        failed = failed.union(f.select("doi", "reason"))
    failed = written(failed.groupBy("doi").agg(F.min("reason").alias("reason")), "crawl-failed")
    hits, dropped, steps = dict(state.hits), state.dropped, []
    for on, chain, method in ((direction != "forward" and state.depth < backward, references, "references"), (direction != "backward" and state.depth < forward, citations, "citations")):
        if on:
            rows, found, lost = _asked(front, chain, sources, method, failed)
            dropped += lost
            for n, c in found.items():
                hits[n] = hits.get(n, 0) + c
            if rows is not None:
                steps.append((rows, "target_doi" if method == "references" else "source_doi"))
    edges, new = state.edges, None
    for rows, end in steps:
        edges = edges.union(rows.where("source_doi <> target_doi"))
        got = rows.select(F.col(end).alias("doi"))
        new = got if new is None else new.union(got)
    nodes = state.nodes
    if names is not None:
        nodes = nodes.join(names, "doi", "left").select("doi", "depth", "is_seed", F.coalesce(F.nullif("said", F.lit("")), "title").alias("title"))
    status, grown = "running", False
    if new is not None:
        new = written(new.where("doi is not null").distinct().join(state.nodes.select("doi"), "doi", "left_anti"), "crawl-new")
        held, met = state.nodes.count(), new.count()
        if most is not None and held + met > most:
            new, status = new.orderBy("doi").limit(max(0, most - held)), FULL
        grown = met > 0 and (most is None or held < most)
        nodes = nodes.union(new.select("doi", F.lit(state.depth + 1).alias("depth"), F.lit(False).alias("is_seed"), F.lit(TITLE).alias("title")))
    if status == "running" and (not grown or state.depth + 1 >= max(backward, forward)):
        status = DONE
    return State(written(nodes, "crawl-nodes"), written(edges.distinct(), "crawl-edges"), failed, state.depth + 1, status, hits, dropped)


def crawl(seeds: DataFrame, sources: dict, references: list[str], citations: list[str], backward: int = 2, forward: int = 1, most: int | None = None, direction: str = "both", checkpoint: str | None = None, resume: bool = False, levels: int | None = None) -> State:
    """A crawl from seeds (seed) until it is done, full, or has gone `levels` levels on; with a checkpoint its state is saved after each level."""
    spark = seeds.sparkSession
    state = load_state(spark, checkpoint) if resume and checkpoint else None
    if state is None:
        empty = lambda ddl: spark.createDataFrame([], ddl)
        state = State(written(seed_nodes(seeds), "crawl-nodes"), empty("source_doi string, target_doi string"), empty("doi string, reason string"))
    while state.status == "running" and (levels is None or levels > 0):
        state = expand(state, sources, references, citations, backward, forward, most, direction)
        levels = None if levels is None else levels - 1
        if checkpoint:
            save_state(state, checkpoint)
    return state


def _move(spark: SparkSession, a: str, b: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(b).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(b), True)
    if not fs.rename(path(a), path(b)):
        raise OSError(f"{a} can't become {b}")


def save_state(state: State, folder: str) -> None:
    """The state's tables under a name of their own, then the file that names them, put in place at once: a stop in between spoils nothing."""
    spark, at = state.nodes.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    for name in ("nodes", "edges", "failed"):
        getattr(state, name).write.parquet(f"{at}/{name}")
    note = json.dumps({"at": at, "depth": state.depth, "status": state.status, "hits": state.hits, "dropped": state.dropped})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state.new")
    _move(spark, f"{folder}/state.new", f"{folder}/state")


def load_state(spark: SparkSession, folder: str) -> State | None:
    """A saved state; None if there is none, or none that can be read."""
    if not there(spark, f"{folder}/state"):
        return None
    try:
        note = json.loads(spark.read.text(f"{folder}/state").first()["value"])
        nodes, edges, failed = (spark.read.parquet(f"{note['at']}/{n}") for n in ("nodes", "edges", "failed"))
    except (ValueError, KeyError, TypeError):
        return None
    return State(nodes, edges, failed, note["depth"], note["status"], note["hits"], note["dropped"])


def clear_state(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def network_lines(state_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, value): nodes and edges of a network as JSON lines."""
    nodes = state_nodes.select(F.lit("node").alias("kind"), F.col("doi").alias("id"), F.to_json(F.struct("doi", "title", "depth", "is_seed")).alias("value"))
    return nodes.union(edges.select(F.lit("edge"), F.concat_ws(" ", "source_doi", "target_doi"), F.to_json(F.struct("source_doi", "target_doi"))))


def network_metadata(state: State, seeds: DataFrame, **config) -> DataFrame:
    """One row (metadata): what a network's document says of itself, as JSON."""
    counts = {"total_nodes": state.nodes.count(), "total_edges": state.edges.count(), "failed_count": state.failed.count(), "dropped_edges_no_doi": state.dropped, "status": state.status, "source_hits": state.hits}
    note = json.dumps({**config, **counts, "seeds": seeds.count()}, sort_keys=True)
    return seeds.sparkSession.createDataFrame([(note,)], "metadata string")


def scratch_checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quill-crawl-{uuid.uuid4().hex}"
