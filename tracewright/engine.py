"""The query operations over one snapshot of a code graph: API-01 to API-12, JOIN-25, JOIN-26.

Each returns a Result. Frames are lazy; what decides a status (a section that isn't there, a name
that is ambiguous) is looked up with a bounded query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .operators import coverage, diff, entry, fold, links, records, review, risk, scope, traverse
from .result import Result


@dataclass(frozen=True)
class Inputs:
    """Tables of a snapshot; those that are None are left out of the map."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    calls: DataFrame | None = None
    implements: DataFrame | None = None
    similar: DataFrame | None = None
    co_changes: DataFrame | None = None
    coverage: dict[str, DataFrame] | None = None
    records: DataFrame | None = None
    gaps: DataFrame | None = None


class Engine:
    """One generation of the map. load() starts the next; what was persisted for the last is let go."""

    def __init__(self, inputs: Inputs, entries: list[str] | None = None):
        self.generation = 0
        self.load(inputs, entries)

    def load(self, inputs: Inputs, entries: list[str] | None = None) -> int:
        """API-08."""
        for df in getattr(self, "_held", {}).values():
            df.unpersist()
        self._held: dict[str, DataFrame] = {}
        self.inputs, self.entries = inputs, list(dict.fromkeys(entries or []))
        self.spark = inputs.nodes.sparkSession
        nodes = inputs.nodes
        if inputs.files is not None:
            nodes = links.hotspots(nodes, inputs.files)
        self.tests = links.tested_by(inputs.nodes, inputs.calls) if inputs.calls is not None else None
        # tests are linked while their nodes are there, and go before anything is folded
        nodes, edges = scope.exclude_tests(nodes, inputs.edges)
        none = self.spark.createDataFrame([], "source string, target string")
        self.modules = fold.modules(nodes, edges)
        self.types = fold.types(self.modules["nodes"], self.modules["edges"], inputs.implements if inputs.implements is not None else none)
        self.nodes, self.edges = scope.filter_to_scope(self._hold("nodes", self.types["nodes"]), self._hold("edges", self.types["edges"]), self.entries)
        self.generation += 1
        return self.generation

    def _hold(self, name: str, df: DataFrame) -> DataFrame:
        self._held[name] = df.persist()
        return self._held[name]

    def _scoped(self, section: str | None) -> tuple[DataFrame, DataFrame] | None:
        what = scope.section_argument(section, self.entries)
        if what == "unknown-section":
            return None
        return (self.nodes, self.edges) if what == "all" else scope.filter_to_section(self.nodes, self.edges, self.entries, section)

    def _unknown(self, section: str | None) -> Result:
        return Result("unknown-section", f"no section {section}", facts={"sections": self.entries})

    def code_map(self, section: str | None = None) -> Result:
        """API-01: nodes with risk signals and severities of this scope, edges, folded frames, links and counts."""
        found = self._scoped(section)
        if found is None:
            return self._unknown(section)
        nodes, edges = found
        measured = nodes.join(traverse.blast_counts(nodes, edges), "id")
        if self.inputs.coverage is not None:
            measured = coverage.gaps(measured, self.inputs.coverage["listed"], self.inputs.coverage["covered"]).withColumn("coverage_gap", F.when(F.col("coverage_gap"), F.lit(1)))
        frames = {"nodes": measured, "edges": edges, "modules": self.modules["modules"], "module_uses": self.modules["uses"], "types": self.types["types"], "used_by": self.types["used_by"]}
        if self.inputs.co_changes is not None:
            frames["co_changes"] = links.co_changes(self.inputs.co_changes)
            top = frames["co_changes"].groupBy("file").agg(F.max("co_changes").alias("co_change"))
            measured = measured.join(top, "file", "left")
        if self.inputs.similar is not None:
            frames["similar"] = links.similar(nodes, self.inputs.similar)
        if self.tests is not None:
            frames["tested_by"] = self.tests.join(nodes.select("id"), "id", "left_semi")
        frames["signals"] = risk.with_severity(risk.signals(measured))
        if self.inputs.records is not None and self.inputs.gaps is not None:
            frames["summaries"] = records.attach(nodes.select("id", "file"), self.inputs.gaps, self.inputs.records)
        if self.entries:
            frames["section_counts"] = scope.section_counts(self.nodes, self.entries)
        if section is not None:
            frames["cross_edges"] = scope.cross_section_edges(self.nodes, self.edges, self.entries).filter(F.col("section") == section)
            frames["cross_calls"] = scope.cross_section_calls(self.nodes, self.edges, self.entries).join(nodes.select("id"), "id", "left_semi")
        return Result("ok", frames=frames, facts={"generation": self.generation})

    def trace_path(self, query: str, section: str | None = None) -> Result:
        """API-02, API-11."""
        found = self._scoped(section)
        if found is None:
            return self._unknown(section)
        nodes, edges = found
        hits = traverse.resolve(nodes, query)
        few = hits.orderBy("id").limit(2).collect()
        if not few:
            folded = traverse.resolve(self.types["types"].select("id", "name", "file"), query)
            if query.strip() and folded.limit(1).collect():
                return Result("folded-type", "the name is a type, which isn't on the map", frames={"types": folded})
            return Result("no-path-found", f"nothing matches {query}")
        if len(few) > 1:
            return Result("ambiguous", f"{few[0]['matches']} nodes match {query}", frames={"candidates": hits.orderBy("id")})
        return Result("found", frames={"tree": traverse.call_tree(nodes, edges, hits.select("id"))}, facts={"start": few[0]["id"]})

    def lookup_node(self, node_id: str, section: str | None = None) -> Result:
        """API-03, JOIN-26."""
        found = self._scoped(section)
        if found is None:
            return self._unknown(section)
        row = records.lookup(node_id, found[0], self.modules["modules"], self.types["types"]).collect()
        if section is not None and row and row[0]["found"] != "node":
            row = [r for r in row if scope_of(r["file"], self.entries) == section]
        if row:
            return Result("found", frames={"node": found[0].filter(F.col("id") == node_id)}, facts={"found": row[0]["found"], "file": row[0]["file"]})
        if section is not None:
            other = records.lookup(node_id, self.nodes, self.modules["modules"], self.types["types"]).collect()
            owner = scope_of(other[0]["file"], self.entries) if other else None
            if owner is not None and owner != section:
                return Result("not-in-section", f"{node_id} belongs to {owner}", facts={"section": owner})
        return Result("not-found", f"no node {node_id}")

    def expand_blast_radius(self, ids: list[str], section: str | None = None) -> Result:
        """API-04."""
        if len(ids) > S.SEEDS_MAX:
            return Result("invalid-arguments", f"at most {S.SEEDS_MAX} ids")
        found = self._scoped(section)
        if found is None:
            return self._unknown(section)
        seeds = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return Result("ok", frames={"hops": traverse.expansion(*found, seeds), "missing": review.missing(seeds, found[0])})

    def entry_candidates(self, pins: list[str] | None = None, section: str | None = None) -> Result:
        """API-05: status none where nothing is pinned and no root reaches enough."""
        found = self._scoped(section)
        if found is None:
            return self._unknown(section)
        nodes, edges = found
        pins = entry.clean_pins(pins or [])
        nodes = nodes if "called_at_load_by" in nodes.columns else fold.module_links(nodes, self.modules["uses"])
        listed, reached = entry.candidates(nodes, edges, pins)
        listed = traverse.cut(listed)
        hidden = review.missing(self.spark.createDataFrame([(p,) for p in pins], "id string"), nodes)
        return Result("none" if listed.isEmpty() else "found", frames={"candidates": listed, "relations": entry.agent_relations(entry.relations(reached, listed)), "hidden_pins": hidden})

    def diff_scope(self, changed: DataFrame, listed: DataFrame, ranges: DataFrame, section: str | None = None) -> Result:
        """API-06."""
        found = self._scoped(section)
        if found is None:
            return self._unknown(section)
        nodes, _ = found
        frames = diff.summary(nodes, self.types["types"], self.types["used_by"], self.modules["modules"], changed, listed, ranges)
        if section is not None:
            hit = self.nodes.join(changed.select("file").distinct(), "file", "left_semi")
            frames["elsewhere"] = scope.changed_elsewhere({"nodes": hit, "files": changed}, self.entries, section)
        return Result("ok", frames=frames)

    def coverage_summary(self, counts: DataFrame, gap_files: DataFrame) -> Result:
        """API-07. counts: one row of indexed, skipped, partial."""
        return Result("ok", frames={"summary": coverage.verdict(counts), "gaps": gap_files})

    def ingest_findings(self, findings: DataFrame, tool: str, before: DataFrame, severity: str | None = None) -> Result:
        """API-09: findings of a tool in place of its earlier ones. nodes need ord."""
        new = diff.findings_of_nodes(self.nodes, findings, tool, severity)
        return Result("ok", frames={"findings": diff.replace_tool(before, new.select(*before.columns), tool)})

    def review_metrics(self, changed_ids: DataFrame, depth: int | None = None, ready: bool = True) -> Result:
        """API-10: the review table once a change is known and expanded; else why there is none."""
        if not ready:
            return Result("not-ready", "the change isn't matched to the map yet")
        hops = traverse.cut(traverse.expansion(self.nodes, self.edges, changed_ids))
        first = review.first_depth(hops).first()
        table = self.nodes.join(traverse.blast_counts(self.nodes, self.edges), "id")
        return Result("ok", frames={"rows": review.rows(table, changed_ids, hops, depth or first["depth"]), "missing": review.missing(changed_ids, self.nodes)}, facts={"max_hop": first["max_hop"], "depth": depth or first["depth"]})

    def revealed(self, shown: DataFrame) -> Result:
        """API-12: nodes and edges among the cards shown."""
        return Result("ok", frames={"nodes": self.nodes.join(shown.select("id").distinct(), "id", "left_semi"), "edges": traverse.induced(self.edges, shown)})


def scope_of(file: str, entries: list[str]) -> str | None:
    """JOIN-14 for one path."""
    owners = [p for p in entries if file == p or file.startswith(p + "/")]
    return max(owners, key=lambda p: (len(p), p)) if owners else None
