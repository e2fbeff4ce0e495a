"""Conversion and renaming of a whole project, and the command line for both."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapperlake.operators import convert, migrate, resolve
from mapperlake.plans.engine import Project
from mapperlake.sinks import mapper_xml, reports
from mapperlake.sources import mapping as mappings


def converted(p: Project) -> tuple[DataFrame, DataFrame]:
    """(owners in the newer dialect, events with their files)."""
    done = convert.converted(p.owners, resolve.qualification(p.include_tree, p.owners), p.map_references).persist()
    return done.drop("events"), convert.events(done)


def renamed(p: Project, definition: dict, keep_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(owners with their names replaced, events with their files). The mapping must be valid."""
    found = mappings.validate(definition)
    if found["errors"]:
        raise ValueError(f"the mapping has errors: {found['errors'][:3]}")
    plain = mappings.unwrap(definition)
    done = migrate.scanned(p.rendered, plain, keep_labels).unionByName(migrate.standalone(p.owners, p.include_tree, plain)).persist()
    files = p.owners.groupBy("qid").agg(F.min("source_file").alias("source_file"))
    events = migrate.events(done).join(files, F.col("owner") == F.col("qid"), "left").drop("qid")
    return migrate.migrated_owners(p.owners, migrate.edits(done)), events


def preview(p: Project, definition: dict, statement: str) -> DataFrame:
    """before, after of one statement's own file."""
    owners, _ = renamed(p, definition)
    one = p.owners.where(F.col("qid") == statement).select("source_file").distinct()
    return mapper_xml.shaped(mapper_xml.documents(p.owners.join(one, "source_file", "left_semi")), mapper_xml.documents(owners.join(one, "source_file", "left_semi")))


def main(argv: list[str] | None = None) -> int:
    """python -m mapperlake.plans.migration PROJECT OUT [--mapping FILE] [--convert] [--keep-labels] [--fail-on GRADE]"""
    from mapperlake.session import build_session, ship

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("project")
    parser.add_argument("out")
    parser.add_argument("--mapping")
    parser.add_argument("--convert", action="store_true")
    parser.add_argument("--keep-labels", action="store_true")
    parser.add_argument("--fail-on", choices=["WARNING", "MANUAL", "ERROR"])
    args = parser.parse_args(argv)
    spark = build_session("mapperlake migration")
    ship(spark)
    p = Project.open(spark, args.project)
    events, owners = [], p.owners
    if args.mapping:
        owners, found = renamed(p, mappings.read(args.mapping), args.keep_labels)
        events.append(found.select("source_file", "owner", "code", "grade"))
    if args.convert:
        base = Project.open(spark, args.project)
        base.owners = owners.persist()
        owners, found = converted(base)
        events.append(found.select("source_file", "owner", "code", "grade"))
    every = events[0] if len(events) == 1 else events[0].unionByName(events[1]) if events else spark.createDataFrame([], "source_file string, owner string, code string, grade string")
    report = reports.write_tree(mapper_xml.documents(owners), reports.tallies(every, p.mappers), reports.review_list(every), args.out)
    bad = {"WARNING": ("WARNING", "MANUAL", "ERROR"), "MANUAL": ("MANUAL", "ERROR"), "ERROR": ("ERROR",)}.get(args.fail_on, ())
    return 2 if any(report["grades"][g] for g in bad) else 0


if __name__ == "__main__":
    sys.exit(main())
