"""What a user calls: check uploads, analyse cases, look up results; and a command line.

Everything works on tables of cases; nothing is computed before a result is read.

    python -m titleforge.api SESSIONS --list
    python -m titleforge.api DOCUMENTS --case c1 --json
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chain, fact_store, guardrails, identity, reports, rules, scoring
from .sources import tables
from .sources.cases import CaseTables

#: Megabytes of an upload and files of a case at most.
UPLOAD_MB, FILES = 50, 10


def uploads(files: DataFrame) -> DataFrame:
    """path, length, content of uploaded files -> their safe names and what speaks against them."""
    name = tables.safe_filename(F.col("path"))
    why = F.when(~F.lower("path").endswith(".pdf"), "not a PDF").when(F.col("length") > (UPLOAD_MB << 20), "too large").when(~tables.valid_pdf(F.col("content"), F.col("length"), UPLOAD_MB << 20), "empty or damaged")
    return files.select("path", name.alias("filename"), "length", why.alias("refused"))


@dataclass
class Analysis:
    """All that follows from the records of cases, each as a table."""

    documents: DataFrame
    as_of: str
    #: Checks of a model (case_id, rule_code, severity, status, evidence, source), if there are any.
    judged: DataFrame | None = None
    #: Rules to run, and kinds of record that occur; None for all. Fewer make a smaller plan.
    only: list[str] | None = None
    kinds: tuple[str | None, ...] | None = None

    @cached_property
    def cases(self) -> CaseTables:
        return CaseTables(self.documents)

    @cached_property
    def facts(self) -> DataFrame:
        return self.cases._kept(fact_store.extract(self.documents, self.kinds))

    @cached_property
    def conflicts(self) -> DataFrame:
        return fact_store.conflicts(self.facts)

    @cached_property
    def persons(self) -> DataFrame:
        return identity.summaries(self.cases.resolved)

    @cached_property
    def checks(self) -> DataFrame:
        """Checks of the rules and the model: one per code, superseded ones marked."""
        own = rules.run(self.cases, self.as_of, self.only).select("case_id", "rule_code", "severity", "status", "evidence", "source")
        every = own if self.judged is None else own.unionByName(self.judged.select(own.columns))
        rows = every.withColumns({"guardrail_warnings": F.array().cast("array<string>"), "verified": F.lit(False), "pos": F.xxhash64(*own.columns)})
        return self.cases._kept(scoring.supersede(scoring.dedup(rows, ["case_id"]), ["case_id"]))

    @cached_property
    def scores(self) -> DataFrame:
        """A row per case; cases without a check have the full score."""
        all_ = self.documents.select("case_id").distinct().join(scoring.score(self.checks, ["case_id"]), "case_id", "left")
        full = all_.withColumns({"deduction": F.coalesce("deduction", F.lit(0)), "score": F.coalesce("score", F.lit(100))})
        return full.withColumn("band", scoring.band(F.col("score")))

    @cached_property
    def chain(self) -> DataFrame:
        return chain.build(self.documents)

    @cached_property
    def summary(self) -> DataFrame:
        return reports.property_summary(self.documents)

    def report(self) -> DataFrame:
        return reports.report(self.scores, self.checks, self.summary, self.chain)

    def memory_bank(self) -> DataFrame:
        return fact_store.context_text(self.facts, self.conflicts)

    def chat(self, question: Column, narrative: DataFrame | None = None) -> DataFrame:
        """case_id and the prompt of a question; ``narrative``: case_id, narrative."""
        told = self.memory_bank()
        if narrative is not None:
            told = told.join(narrative, "case_id", "left")
        return told.select("case_id", guardrails.chat_prompt(F.col("context"), F.col("narrative") if narrative is not None else F.lit(""), question).alias("prompt"))

    def sessions(self, now: Column) -> DataFrame:
        """A finished session per case, as :func:`..sources.tables.save_sessions` writes them."""
        return self.scores.select(F.col("case_id").cast("string").alias("session_id"), F.lit("completed").alias("status"), F.lit("done").alias("stage"), now.alias("created_at"), now.alias("updated_at"), F.col("score").cast("int").alias("risk_score"), F.lit(None).cast("string").alias("error"))

    def release(self) -> None:
        self.cases.release()
        for name in ("facts", "checks"):
            if name in vars(self):
                vars(self)[name].unpersist()


def status(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id).select("session_id", "status", "stage", "risk_score", "error")


def clear(sessions: DataFrame, session_id: str) -> DataFrame:
    """The sessions without one."""
    return sessions.where(F.col("session_id") != session_id)


def tool(facts: DataFrame, name: str, **how) -> DataFrame:
    """The tools that a model may call, by name."""
    known = {"query_knowledge_base": query_knowledge_base}
    if name not in known:
        raise ValueError(f"no tool {name!r}")
    return known[name](facts, **how)


def query_knowledge_base(facts: DataFrame, category: str | None = None, key: str | None = None, source_file: str | None = None) -> DataFrame:
    """Facts of a source, else of a category (and key); without either, counts per category."""
    if source_file:
        return facts.where(F.col("source_file") == source_file)
    if category:
        return facts.where((F.col("category") == category) & (F.lit(True) if key is None else F.col("key") == key))
    return facts.groupBy("category").agg(F.count("*").alias("n_facts"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Check cases of land records.")
    p.add_argument("path", help="sessions (with --list) or records: case_id, doc_ord, filename, document_type, data")
    p.add_argument("--list", action="store_true", help="list the saved sessions")
    p.add_argument("--case", help="only this case")
    p.add_argument("--as-of", default="2024-01-01", help="the day that ages are measured at")
    p.add_argument("--json", action="store_true", help="print checks as JSON lines")
    p.add_argument("--trace", action="store_true", help="print the plan of the checks too")
    args = p.parse_args(argv)
    spark: SparkSession = tables.session()
    if args.list:
        tables.sessions(spark, args.path).select("session_id", "status", "risk_score", "updated_at").show(1000, truncate=False)
        return
    records = spark.read.parquet(args.path)
    found = Analysis(records if args.case is None else records.where(F.col("case_id").cast("string") == args.case), args.as_of)
    checks = found.checks.select("case_id", "rule_code", "severity", "status", "evidence").orderBy("case_id", "rule_code")
    if args.trace:
        checks.explain("formatted")
    for row in checks.toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False) if args.json else f"{row.case_id}  {row.status:<8} {row.severity:<8} {row.rule_code}: {row.evidence}")


if __name__ == "__main__":
    main()
