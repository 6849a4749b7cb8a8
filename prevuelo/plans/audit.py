"""The whole audit: frames in, every result out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prevuelo.functions.wording import NO_DATA_ERROR
from prevuelo.operators import candidates as keys
from prevuelo.operators import enrichment, report, rows, score
from prevuelo.operators.dossier import dossiers
from prevuelo.operators.findings import findings, rule_status
from prevuelo.operators.measure import column_facts, measure, row_facts
from prevuelo.operators.samples import sample_values
from prevuelo.sources.csv import read_all, refusal
from prevuelo.sources.frames import Frame, Records
from prevuelo.sources.shared import written

@dataclass(frozen=True)
class Audit:
    """Results of one audit job over any number of datasets, all of them DataFrames.

    ``facts`` is stored before anything else is derived from it, so the audited rows are
    scanned once for the measures and once, pruned, for the sample values.
    """

    sources: tuple[Frame | Records, ...]
    facts: DataFrame
    parse_errors: DataFrame | None = None
    rejected: DataFrame | None = None  # (dataset_id, status, error) of what never reached the audit

    @cached_property
    def frames(self) -> tuple[Frame, ...]:
        """The sources as frames, one for each header."""
        return tuple(f for s in self.sources for f in (s.frames() if isinstance(s, Records) else [s]))

    @cached_property
    def summary(self) -> DataFrame:
        """(dataset_id, row_count, column_count, parse_error_count)."""
        widths = column_facts(self.facts).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("column_count"))
        base = row_facts(self.facts).select("dataset_id", "row_count").join(widths, "dataset_id")
        if self.parse_errors is None:
            return base.withColumn("parse_error_count", F.lit(0).cast("bigint"))
        errors = self.parse_errors.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
        return base.join(errors, "dataset_id", "left").select(
            *base.columns, F.coalesce("n", F.lit(0)).alias("parse_error_count")
        )

    @cached_property
    def profile(self) -> DataFrame:
        """One line per dataset and column, with sample values."""
        samples = sample_values(list(self.sources), self.facts)
        return (
            column_facts(self.facts)
            .drop("sample_bound")
            .join(samples, ["dataset_id", "column_pos"], "left")
            .withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
        )

    @cached_property
    def findings(self) -> DataFrame:
        return findings(self.facts)

    @cached_property
    def rule_status(self) -> DataFrame:
        return rule_status(self.facts)

    @cached_property
    def candidates(self) -> DataFrame:
        return keys.candidates(self.facts)

    @cached_property
    def evidence(self) -> DataFrame:
        return keys.evidence(self.facts)

    @cached_property
    def scores(self) -> DataFrame:
        return score.scores(row_facts(self.facts).select("dataset_id"), self.findings)

    @cached_property
    def breakdown(self) -> DataFrame:
        return score.breakdown(self.findings)

    @cached_property
    def ranking(self) -> DataFrame:
        return score.ranking(self.scores)

    @cached_property
    def dossiers(self) -> DataFrame:
        return dossiers(self.facts, self.findings, self.candidates)

    @cached_property
    def payloads(self) -> DataFrame:
        return enrichment.payloads(self.dossiers)

    @cached_property
    def prompts(self) -> DataFrame:
        return enrichment.prompts(self.dossiers)

    def preview(self, dataset: str | None = None) -> DataFrame:
        """The first rows of the frame that is called ``dataset`` (or of the only source)."""
        chosen = [f for f in self.sources if dataset is None or (isinstance(f, Frame) and f.name == dataset)]
        if dataset is not None and not chosen:
            # a source of many datasets: the one that has this one
            mine = F.col("dataset") == dataset
            of_many = [(r, r.names_of(dataset)) for r in self.sources if isinstance(r, Records)]
            parts = [r.frame_of(names, mine) for r, names in of_many if names]
            parts += [replace(f, rows=f.rows.filter(mine)) for f in self.sources if isinstance(f, Frame) and f.name is None]
            chosen = [f for f in parts if not f.rows.isEmpty()]
        if len(chosen) == 1 and isinstance(chosen[0], Records):
            chosen = list(chosen[0].frames())
        if len(chosen) != 1:
            raise ValueError(f"{len(chosen)} frames match {dataset!r}")
        return rows.preview(chosen[0])

    def previews(self) -> DataFrame:
        """(dataset_id, nth, column_pos, column_name, value) of the first rows of every dataset read from files."""
        return reduce(DataFrame.unionByName, [rows.record_previews(s) for s in self.sources if isinstance(s, Records)])

    def statuses(self, expected: DataFrame) -> DataFrame:
        """What became of each expected dataset (dataset_id): audited, no_data, or why it was rejected."""
        done = row_facts(self.facts).select("dataset_id", F.lit("audited").alias("audited"))
        out = expected.join(done, "dataset_id", "left")
        state = F.coalesce("audited", F.lit("no_data"))
        if self.rejected is None:
            return out.select("dataset_id", state.alias("status"))
        why = self.rejected.select("dataset_id", F.col("status").alias("refused"))
        return out.join(why, "dataset_id", "left").select("dataset_id", F.coalesce("refused", state).alias("status"))

    def explanations(self, answers: DataFrame) -> DataFrame:
        return enrichment.merge_explanations(self.findings, answers)

    def executive_summaries(self, answers: DataFrame) -> DataFrame:
        return enrichment.merge_summaries(self.scores, answers)

    def report_lines(self, decisions: DataFrame | None = None, title: str = report.TITLE) -> DataFrame:
        decided = self.candidates if decisions is None else keys.decide(self.candidates, decisions)
        return report.report_lines(
            self.summary, self.profile, self.findings, self.scores, decided, self.parse_errors, title
        )

    def reports(self, decisions: DataFrame | None = None, title: str = report.TITLE) -> DataFrame:
        """(dataset_id, file_name, document): one whole text per dataset, as any single value in memory.

        ``write_reports(audit.report_lines(), path)`` streams reports of any length.
        """
        return report.report_documents(self.report_lines(decisions, title))


def audit(*frames: Frame | Records, parse_errors: DataFrame | None = None, rejected: DataFrame | None = None) -> Audit:
    """Measure all frames in one job and return the results derived from the measures."""
    return Audit(frames, written(measure(*frames), "facts"), parse_errors, rejected)


def audit_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    dataset_id: Callable[[Column], Column] | None = None,
    max_bytes: int | None = None,
) -> Audit:
    """Audit every CSV file below ``path`` in one job and one plan, whatever their headers and separators.

    ``dataset_id`` may put several files into one dataset as long as they share a header.
    """
    found = read_all(spark, path, sep, dataset_id, max_bytes)
    if found.records.headers.isEmpty():
        raise ValueError(refusal(found.files))
    # stored beside the facts: the files are parsed for them once, whatever is derived later
    errors = written(found.parse_errors, "parse-errors")
    rejected = found.files.filter(F.col("status") != "accepted").select("dataset_id", "status", "error")
    return audit(found.records, parse_errors=errors, rejected=rejected)


def require_data(result: Audit) -> Audit:
    """Strict mode: raise when a named frame kept no rows."""
    named = [f.name for f in result.sources if isinstance(f, Frame) and f.name is not None]
    present = {r.dataset_id for r in row_facts(result.facts).filter(F.col("dataset_id").isin(named)).collect()}
    empty = sorted(set(named) - present)
    if empty:
        raise ValueError(f"{NO_DATA_ERROR} ({', '.join(empty)})")
    return result
