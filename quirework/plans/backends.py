"""Names of backends: what a configuration may ask for, and the operators that it gets.

A registry maps names to functions of DataFrames. Adding a backend is `register`; an unknown name is an error that lists the known
ones, never a silent default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from ..operators import answers, evidence, facts, locate, planning, rank, reading, select, shortlists, strategies


class Registry:
    def __init__(self, what: str, entries: dict[str, Callable] | None = None):
        self.what, self._entries = what, dict(entries or {})

    def register(self, name: str, backend: Callable | None = None) -> Callable:
        """Adds a backend, or is a decorator that does; a name that is taken is an error."""
        if backend is None:
            return lambda f: self.register(name, f)
        if name in self._entries:
            raise ValueError(f"{self.what} {name} is registered already")
        self._entries[name] = backend
        return backend

    def __getitem__(self, name: str) -> Callable:
        if name not in self._entries:
            raise KeyError(f"no {self.what} {name}; there are {', '.join(sorted(self._entries))}")
        return self._entries[name]

    def __contains__(self, name: object) -> bool:
        return name in self._entries

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def known(self, names: Iterable[str]) -> list[tuple[str, Callable]]:
        """Backends of these names, each once, in order; unknown names are passed over (recall only gets less)."""
        return [(n, self._entries[n]) for n in dict.fromkeys(names) if n in self._entries]


RETRIEVERS = Registry("retriever", {"bm25": rank.bm25, "dense": rank.dense_top, "rrf": rank.rrf})
STRATEGIES = Registry("strategy", {"name": strategies.name_strategy, "baseline": strategies.baseline_strategy, "citation": strategies.text_strategy, "object": strategies.text_strategy, "property": strategies.text_strategy, "knn": rank.dense_top})
STAGES = Registry("stage", {"deterministic-filter": select.definite_filter, "rerank": shortlists.reranked, "attestation": select.attest, "llm-validator": shortlists.validated})
RERANKERS = Registry("reranker", {"scores": shortlists.reranked})
EXPANDERS = Registry("expander", {"dense": rank.centroids})
ANSWERS = Registry("answer strategy", {"freeform": planning.freeform_route, "multiple_choice": answers.choose_options, "table": facts.last_rows, "table_planned": answers.assemble, "table_planned_native": facts.null_fill_proofs, "table_planned_visual_fill": answers.fill_nulls})
FACTS = Registry("fact producer", {"proposals": facts.admissions, "consensus": answers.consensus, "agreement": answers.agreed, "scalars": facts.scalar_fills})
LOCALIZERS = Registry("localizer", {"index": locate.locate_indexed, "hybrid": locate.hybrid, "union": locate.united, "focused": reading.shortlist, "targeted": locate.targeted_requests})
LEDGERS = Registry("ledger builder", {"lines": locate.typed_lines, "entries": locate.entry_blocks})
LOCATORS = Registry("evidence locator", dict.fromkeys(evidence.SOURCE_TYPES, evidence.emit))
SERIALIZERS = Registry("answer serializer", dict.fromkeys(("freeform", "multiple_choice", "table"), planning.serialized))
PROPOSALS = Registry("proposal source", {"table": lambda df: df})
POLICIES = Registry("selection policy", {"gate": lambda c, a: shortlists.by_policy(c, a, "gate"), "rank": lambda c, a: shortlists.by_policy(c, a, "rank"), "property_first": select.property_first, "target_coverage": select.target_coverage, "answer_bearing": select.answer_bearing})


def cascade(names: list[str], stages: Registry = STAGES) -> list[tuple[str, Callable]]:
    """The stages of a cascade in order. No names are no stages (everything passes); an unknown one is an error."""
    return [(name, stages[name]) for name in names]


def routed(rows: DataFrame, names: list[str], arguments: dict[str, tuple], strategies: Registry = STRATEGIES) -> dict[str, DataFrame]:
    """What each known strategy of these names gives for its arguments; `rows` limits all to their questions."""
    asked = rows.select("query_id").distinct()
    return {name: backend(*arguments[name]).join(asked, "query_id", "left_semi") for name, backend in strategies.known(names) if name in arguments}
