"""Decision flows: search, rules, and an optional reranker.

A reranker is any object with choose(query, candidates, name, compname) that
returns a number from 1 to the number of candidates or None, and optionally
verify(query, candidate, name, compname) -> bool. It runs in Python workers,
batch by batch, on the queries that the rules leave open and no others; by
default there is none. All flows return one row per query: query_id, item_id,
code, m_name, m_comp, m_pack, m_strength, score, method; no match leaves the
item's columns null.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking, rules
from ..storage import written


class Reranker(Protocol):
    def choose(self, query: str, candidates: list[dict[str, Any]], name: str, compname: str) -> int | None: ...


@dataclass
class PromptReranker:
    """Asks a language model: ask(prompt) -> answer. The prompt lists the candidates by number."""

    ask: Any
    with_company: bool = True

    def prompt(self, query: str, candidates: list[dict[str, Any]], compname: str = "") -> str:
        company = f" (Co: {compname.strip()})" if self.with_company and compname.strip() not in ("", "--") else ""
        lines = [f"{i}. {c['c_name']} (Pack: {c['c_pack']}, Co: {c['c_comp']})" for i, c in enumerate(candidates, 1)]
        return "\n".join([f"Which candidate is this product: {query}{company}", "Candidates:", *lines, 'Answer with {"match_number": N} or {"match_number": null} alone.'])

    def choose(self, query: str, candidates: list[dict[str, Any]], name: str, compname: str) -> int | None:
        return parsed_choice(self.ask(self.prompt(query, candidates, compname)), len(candidates))

    def verify(self, query: str, candidate: dict[str, Any], name: str, compname: str) -> bool:
        """VER1: an answer that has YES in it accepts."""
        return "YES" in self.ask(f"Are these the same product? Answer YES or NO.\n1. {query}\n2. {candidate['c_name']} {candidate['c_pack']}").upper()


def parsed_choice(answer: str, n: int) -> int | None:
    """EN2: the number in an answer's fenced JSON object, or else from its first brace to its last."""
    found = re.search(r"```json\s*(\{.*?\})\s*```", answer, re.S) or re.search(r"(\{.*\})", answer, re.S)
    try:
        number = json.loads(found[1]).get("match_number") if found else None
    except (ValueError, AttributeError):
        return None
    return int(number) if isinstance(number, int) and 1 <= number <= n else None


@dataclass(frozen=True)
class Flow:
    """Thresholds and steps of a cascade."""

    name: str
    profile: rules.Profile = rules.CURRENT
    twice: bool = False  # a second search for poor results
    with_company: bool = True  # whether the search sees the company
    accept: float = 95  # score at which the rules decide
    low_without_model: bool = False  # without a reranker, lower scores are accepted too
    prefilter: bool = False  # the reranker sees valid candidates only
    verify: bool = False  # the reranker first confirms the rules' choice
    any_score: bool = False  # the rules' first choice is accepted whatever its score


SERVER = Flow("server", twice=True)
BATCH = Flow("batch", accept=75, low_without_model=True, prefilter=True)
OLD_SERVER = Flow("old_server", rules.OLD, with_company=False, verify=True)
HYBRID = Flow("hybrid", rules.HYBRID, with_company=False, any_score=True)
FLOWS = {f.name: f for f in (SERVER, BATCH, OLD_SERVER, HYBRID)}

ITEM = ["item_id", "code", "c_name", "c_comp", "c_pack", "c_strength"]


def candidate_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows that rules judge: queries (query_id, name, pack, compname[, query]) with their hits."""
    given = "query" if "query" in queries.columns else None
    q = queries.select("query_id", T.query_text("name", "pack", given).alias("query"), T._text("name").alias("q_name"), T._text("pack").alias("q_pack"), T._text("compname").alias("q_comp"))
    h = hits.select("query_id", "rank", "item_id", "code", F.col("name").alias("c_name"), F.col("compname").alias("c_comp"), F.col("pack").alias("c_pack"), F.col("strength").alias("c_strength"))
    return q.join(h, "query_id")


def reranked(rows: DataFrame, profile: rules.Profile, reranker: Reranker, open_: DataFrame) -> DataFrame:
    """LLM1: the reranker's choice for the queries of open_ that passes the strict rules; one row per choice."""
    fields = ["rank", *ITEM]
    lists = rows.join(open_.select("query_id"), "query_id", "left_semi").groupBy("query_id", "query", "q_name", "q_comp").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))

    def choose(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                cands = [dict(x.asDict() if hasattr(x, "asDict") else x) for x in r.c]
                n = reranker.choose(r.query, cands, r.q_name, r.q_comp)
                if n is not None and 1 <= n <= len(cands):
                    out.append((r.query_id, int(cands[n - 1]["rank"])))
            yield pd.DataFrame(out, columns=["query_id", "rank"])

    chosen = lists.mapInPandas(choose, "query_id bigint, rank int")
    strict = rules.judged(written(rows.join(chosen, ["query_id", "rank"]), "chosen"), profile, strict=True)
    return strict.filter("valid")


def _verified(found: DataFrame, reranker) -> DataFrame:

    def ask(batches):
        for pdf in batches:
            keep = [bool(reranker.verify(r["query"], r, r["q_name"], r["q_comp"])) for r in pdf.to_dict("records")]
            yield pdf[keep]

    return found.mapInPandas(ask, found.schema)


def run(queries: DataFrame, items: DataFrame, flow: Flow = BATCH, reranker: Reranker | None = None, top_k: int = 5) -> DataFrame:
    """CA1 to CA3, and CA4 but for its cache. queries: query_id, name, pack, compname[, query]; items: prepared()."""
    asked = queries if flow.with_company else queries.withColumn("compname", F.lit(""))
    hits = ranking.search_twice(asked, items, top_k) if flow.twice else ranking.search(asked, items, top_k)
    # a few short rows per query; written, as each rule reads them and the planner would weigh search and rules as one
    rows = written(candidate_rows(queries, hits), "rows")
    found = written(rules.first_accepted(rules.judged(rows, flow.profile)), "found")  # a row per query at most
    sure = F.lit(True) if flow.any_score else F.col("score") >= flow.accept
    method = F.lit("Heuristic")
    if reranker is None and flow.low_without_model:
        method, sure = F.when(F.col("score") >= flow.accept, "Heuristic").otherwise("Heuristic (Low)"), F.lit(True)
    done = found.filter(sure).select("query_id", *ITEM, "score", method.alias("method"))
    if reranker is not None:
        if flow.verify:
            kept = _verified(found.filter(~sure), reranker)
            done = done.unionByName(kept.select("query_id", *ITEM, "score", F.lit("Verified").alias("method")))
        open_ = rows.select("query_id").distinct().join(done, "query_id", "left_anti")
        shown = rules.judged(rows, flow.profile).filter("valid").select(rows.columns) if flow.prefilter else rows
        picked = reranked(shown, flow.profile, reranker, open_)
        done = done.unionByName(picked.select("query_id", *ITEM, "score", F.lit("AI Match").alias("method")))
    named = done.select("query_id", "item_id", "code", F.col("c_name").alias("m_name"), F.col("c_comp").alias("m_comp"), F.col("c_pack").alias("m_pack"), F.col("c_strength").alias("m_strength"), "score", "method")
    return queries.select("query_id").join(named, "query_id", "left").withColumn("method", F.coalesce("method", F.lit("No Match")))


def run_cached(queries: DataFrame, items: DataFrame, store, reranker: Reranker | None = None) -> DataFrame:
    """CA4 with its cache (sources.cache.ResultCache): hits come from there, all else is matched and stored, misses too."""
    hits = written(store.lookup(queries, items).select("query_id", "item_id", "code"), "hits")
    named = hits.join(items.select("item_id", F.col("name").alias("m_name"), F.col("compname").alias("m_comp"), F.col("pack").alias("m_pack"), F.col("strength").alias("m_strength")), "item_id")
    known = named.select("query_id", "item_id", "code", "m_name", "m_comp", "m_pack", "m_strength", F.lit(None).cast("double").alias("score"), F.lit("Cache").alias("method"))
    rest = queries.join(hits.select("query_id"), "query_id", "left_anti")
    new = written(run(rest, items, HYBRID, reranker), "new")
    store.save(rest, new)
    return known.unionByName(new)


def run_browser(queries: DataFrame, items: DataFrame) -> DataFrame:
    """CA5: the best item of the browser's search where it passes the browser's rules."""
    hits = ranking.browser_search(queries, items, top_k=1)
    rows = candidate_rows(queries.drop("query") if "query" in queries.columns else queries, hits)
    done = rules.browser_judged(rows).filter("accepted")
    named = done.select("query_id", "item_id", "code", F.col("c_name").alias("m_name"), F.col("c_comp").alias("m_comp"), F.col("c_pack").alias("m_pack"), F.col("c_strength").alias("m_strength"), F.lit(None).cast("double").alias("score"), F.lit("Browser").alias("method"))
    return queries.select("query_id").join(named, "query_id", "left").withColumn("method", F.coalesce("method", F.lit("No Match")))
