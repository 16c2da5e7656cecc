"""A whole project: configs and scripts to parameters, lineage, dependencies and failures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowflow.operators import graph
from rowflow.plans import corpus, lineage, workflow
from rowflow.plans.declares import resolve_declares
from rowflow.session import cut_lineage


@dataclass(frozen=True)
class Project:
    processes: DataFrame
    dependencies: DataFrame
    parameters: DataFrame
    facts: DataFrame
    edges: DataFrame
    declared: DataFrame
    failures: DataFrame

    def nodes(self) -> DataFrame:
        """The datasets of all scripts, see :func:`rowflow.plans.lineage.nodes`."""
        return lineage.nodes(self.edges, self.facts)

    def links(self, at: Column, prefix: str) -> DataFrame:
        """Portal addresses of stored inputs and outputs whose declarations are understood."""
        return lineage.links(self.nodes(), lineage.last_understood(self.declared), at, prefix)

    def trace(self, folder: str | None = None, names: list[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of scripts and events up- and downstream of the scripts whose config lies
        in ``folder`` or that are named."""
        return graph.trace(self.dependencies, workflow.targets(self.processes, folder, names), direction)

    def contracted(self) -> tuple[DataFrame, DataFrame]:
        """Scripts that feed each other over an event, and the events nobody makes."""
        return graph.contract(self.dependencies)

    def rejects(self) -> DataFrame:
        """``(script, pos, text)`` of the declarations that are not understood."""
        return self.declared.filter(~F.col("understood") & F.col("value").isNotNull()).select("script", "pos", F.col("value").alias("text"))


def build(configs: DataFrame, scripts: DataFrame, defaults: DataFrame, today: Column | None = None) -> Project:
    """``configs(path, text)``, ``scripts(script, text)``, ``defaults(key, value)``.

    A script is read with the parameters of the first process that runs it, and with the
    defaults for names its process does not set. Configs are parsed once and written, as are
    the facts of the scripts and their evaluated declarations (``today`` is what DateTime.Today
    means); everything else is read off these tables.
    """
    parsed = cut_lineage(workflow.parse_configs(configs))
    masters = workflow.first_masters(parsed)
    procs = workflow.processes(parsed)
    on = workflow.enabled(procs, workflow.memberships(masters))
    params = workflow.process_params(parsed, masters)
    own = params.join(workflow.script_processes(procs), "process").select("script", "key", "value")
    facts = cut_lineage(corpus.facts(corpus.statements(corpus.prepare(scripts, own, defaults))))
    return Project(
        processes=on,
        dependencies=workflow.dependency_edges(on),
        parameters=params,
        facts=facts,
        edges=lineage.edges(facts),
        declared=cut_lineage(resolve_declares(corpus.declares(facts).select("script", "key", "value", "pos"), today)),
        failures=workflow.failures(parsed),
    )
