"""Report files: rows of events by file and grade, a review list, and Markdown of both. Written by Spark, or into one folder that executors have mounted."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.plans.reports import GRADES


def tallies(events: DataFrame, files: DataFrame) -> DataFrame:
    """source_file and the number of events of each grade, files without events included."""
    counted = events.groupBy("source_file").pivot("grade", GRADES).count()
    return files.select("source_file").distinct().join(counted, "source_file", "left").fillna(0, GRADES)


def review_list(events: DataFrame) -> DataFrame:
    """What a person has to look at: MANUAL and ERROR events."""
    return events.where(F.col("grade").isin("MANUAL", "ERROR"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def inside(root: Path, name: str) -> Path:
    """A path below root; names that lead out of it are refused."""
    path = (root / name).resolve()
    if not path.is_relative_to(root.resolve()):
        raise ValueError(f"{name} leads out of {root}")
    return path


def write_documents(docs: DataFrame, out: str) -> DataFrame:
    """Write each document below out, a folder that executors have mounted: n of each task. A task that runs again replaces its files as a whole."""

    def run(batches):
        n = 0
        for pdf in batches:
            for dialect, name, xml in zip(pdf["dialect"], pdf["source_file"], pdf["xml"], strict=True):
                path = inside(Path(out) / dialect, name)
                path.parent.mkdir(parents=True, exist_ok=True)
                part = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
                part.write_text(xml, encoding="utf-8")
                os.replace(part, path)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return docs.select("dialect", "source_file", "xml").mapInPandas(run, "n long")


def write_tree(docs: DataFrame, tally: DataFrame, review: DataFrame, out: str) -> dict:
    """Documents below out, written by tasks; report.json and report.md beside them, row by row. The result has the totals alone."""
    root = Path(out)
    root.mkdir(parents=True, exist_ok=True)
    n = write_documents(docs, out).agg(F.sum("n")).first()[0] or 0
    tally = tally.persist()
    sums = tally.agg(*[F.coalesce(F.sum(g), F.lit(0)).alias(g) for g in GRADES]).first().asDict()
    said = lambda row: json.dumps(row.asDict(), default=str)
    with open(root / "report.json", "w", encoding="utf-8") as f, open(root / "report.md", "w", encoding="utf-8") as md:
        f.write(f'{{"files": {n}, "grades": {json.dumps(sums)}, "by_file": [')
        md.write("| file | " + " | ".join(GRADES) + " |\n| --- |" + " --- |" * len(GRADES) + "\n")
        for k, r in enumerate(tally.orderBy("source_file").toLocalIterator()):
            f.write(("," if k else "") + "\n " + said(r))
            md.write(f"| {r['source_file']} | " + " | ".join(str(r[g]) for g in GRADES) + " |\n")
        f.write('\n], "review": [')
        for k, r in enumerate(review.toLocalIterator()):
            f.write(("," if k else "") + "\n " + said(r))
        f.write("\n]}\n")
    tally.unpersist()
    return {"files": n, "grades": sums}
