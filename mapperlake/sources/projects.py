"""Project folders and uploads as a `files` table: discovery, charsets, classification, copies left by builds."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapperlake.sources import markup

#: Folders of tools, not of sources.
IGNORED_FOLDERS = ["node_modules", ".git", ".svn", ".hg", ".idea", ".vscode", ".gradle", ".settings"]
#: Top-level folders that builds write to.
BUILD_FOLDERS = ["target", "build", "dist", "out", "bin", "classes"]
MAX_BYTES, HEAD_BYTES = 20 << 20, 8192
#: Kinds by root element.
KINDS = {"sqlMap": "IBATIS_MAPPER", "sqlMapConfig": "IBATIS_CONFIG", "mapper": "MYBATIS_MAPPER", "configuration": "MYBATIS_CONFIG"}
_KOREAN = re.compile(r"(?i)^(ms949|cp949|x-windows-949|windows-949|ks_c_5601-1987|ksc5601|ksc_5601|euc_kr|euckr|euc-kr)$")


def detect_encoding(data: bytes) -> str:
    """By byte order mark, else by the declaration in the first 200 bytes; unknown labels are UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if data.startswith(mark):
            return name
    m = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([-\w.]+)[\"']", data[:200])
    label = m[1].decode("ascii").lower() if m else "utf-8"
    if _KOREAN.match(label):
        return "euc-kr"
    try:
        codecs.lookup(label)
        return label
    except LookupError:
        return "utf-8"


def decode(data: bytes) -> tuple[str, str]:
    """Text without a byte order mark, and the encoding."""
    name = detect_encoding(data)
    text = data.decode("cp949" if name == "euc-kr" else name, "replace")
    return text.removeprefix("\ufeff"), name


def classify(text: str) -> str:
    name = markup.root_name(text)
    return "UNREADABLE" if name is None else KINDS.get(name.rpartition(":")[2], "OTHER")


def classify_head(head: bytes) -> str | None:
    """The kind by the first bytes; None if they don't tell yet."""
    name = markup.root_name(decode(head[:HEAD_BYTES])[0])
    return KINDS.get(name.rpartition(":")[2], "OTHER") if name else None


def in_ignored_folder(path: Column) -> Column:
    """Whether a folder of a path (its last part aside) is a tool's."""
    parts = F.split(path, r"[/\\]")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_FOLDERS)))


def copy_score(path: Column) -> Column:
    """4 for a build folder at the top, 3 for a known build path below, 1 for WEB-INF/classes."""
    top = F.split(path, r"[/\\]")[0].isin(BUILD_FOLDERS)
    below = path.rlike(r"(^|[/\\])(target|build|out|bin)[/\\](classes|resources|production|test-classes|generated)([/\\]|$)")
    return F.when(top, 4).otherwise(0) + F.when(below, 3).otherwise(0) + F.when(path.rlike(r"WEB-INF[/\\]classes"), 1).otherwise(0)


_READ = "source_file string, size long, encoding string, kind string, external boolean, text string, reason string"


def decoded(rows: DataFrame) -> DataFrame:
    """Decode and classify rows of source_file, size, content, external."""

    def run(batches):
        for pdf in batches:
            out = []
            for f, n, c, e in zip(pdf["source_file"], pdf["size"], pdf["content"], pdf["external"], strict=True):
                if c is None:
                    out.append((f, n, None, None, e, None, "TOO_LARGE" if n > MAX_BYTES else "UNREADABLE"))
                    continue
                text, encoding = decode(bytes(c))
                kind = classify(text)
                out.append((f, n, encoding, kind, e, text if kind.endswith("MAPPER") else None, None if kind.endswith("MAPPER") else kind))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _READ.split(", ")])

    return rows.mapInPandas(run, _READ)


def scan(spark: SparkSession, root: str, external: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """All XML files below a folder, decoded: `files`, mappers with their text, others with a reason why they are left out.

    Files above max_bytes are never read: the size filter stands before the content.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(root)
    base = re.sub(r"/+$", "", re.sub(r"^[a-z]+:/+", "/", root))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^{re.escape(base)}/", "")
    rows = found.select(path.alias("source_file"), F.col("length").alias("size"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"), F.lit(external).alias("external"))
    return decoded(rows.where(~in_ignored_folder(F.col("source_file"))))


def upload(spark: SparkSession, files: dict[str, str] | list[tuple[str, str]], external: bool = False) -> DataFrame:
    """In-memory files as the same table; a name given twice is an error."""
    rows = list(files.items()) if isinstance(files, dict) else files
    names = [n for n, _ in rows]
    if len(set(names)) < len(names):
        raise ValueError(f"given twice: {sorted({n for n in names if names.count(n) > 1})}")
    data = [(n, len(b := t.encode()), bytearray(b), external) for n, t in rows]
    return decoded(spark.createDataFrame(data, "source_file string, size long, content binary, external boolean"))


def with_references(project: DataFrame, references: DataFrame) -> DataFrame:
    """A project's files and files outside of it that are only read for what they define."""
    return project.unionByName(references.withColumn("external", F.lit(True)))


def drop_copies(files: DataFrame, signature: str = "signature") -> DataFrame:
    """files with `copy_of`: of files with one signature the one of the least copy score, then the shortest path, then the first stays (null); the others name it and get the reason BUILD_COPY."""
    rank = F.struct(copy_score(F.col("source_file")).alias("score"), F.length("source_file").alias("length"), "source_file")
    first = files.where(F.col(signature).isNotNull()).groupBy(signature).agg(F.min(rank)["source_file"].alias("__first"))
    marked = files.join(first, signature, "left").select(*files.columns, "__first")
    lone = F.col("__first").isNull() | (F.col("__first") == F.col("source_file"))
    return marked.withColumn("copy_of", F.when(~lone, F.col("__first"))).withColumn("reason", F.when(~lone, F.lit("BUILD_COPY")).otherwise(F.col("reason"))).drop("__first")


_ID = re.compile(r"<(sqlMap|mapper|select|insert|update|delete|procedure|statement|sql|resultMap)\b[^>]*?\b(namespace|id)\s*=\s*[\"']\s*([^\"']*?)\s*[\"']", re.S)


def salvage(text: str) -> list[dict]:
    """kind, id, line of what a file that can't be parsed defines; comments are blanked first, so lines stay."""
    clean = re.sub(r"<!--.*?(-->|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    kinds = {"sqlMap": "NAMESPACE", "mapper": "NAMESPACE", "sql": "SQL_FRAGMENT", "resultMap": "RESULT_MAP"}
    return [{"kind": kinds.get(m[1], "STATEMENT"), "id": m[3], "line": clean.count("\n", 0, m.start()) + 1} for m in _ID.finditer(clean) if (m[2] == "namespace") == (m[1] in ("sqlMap", "mapper"))]


_DEFINES = "source_file string, namespace string, kind string, id string, line int"


def definitions(files: DataFrame) -> DataFrame:
    """source_file, namespace, kind, id, line by salvage: an index of names that needs no parse."""

    def run(batches):
        for pdf in batches:
            out = []
            for f, t in zip(pdf["source_file"], pdf["text"], strict=True):
                found = salvage(t or "")
                space = next((x["id"] for x in found if x["kind"] == "NAMESPACE"), "")
                out += [(f, space, x["kind"], x["id"], x["line"]) for x in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DEFINES.split(", ")])

    return files.where("text IS NOT NULL").select("source_file", "text").mapInPandas(run, _DEFINES)


def discover_references(missing: DataFrame, outside: DataFrame, rounds: int = 3) -> DataFrame:
    """source_files of `outside` (files beyond the project) that define what `missing` (namespace, id) lacks.

    A namespace is met by every file that defines it; a bare id (empty namespace) only by a file that alone
    defines it. Files found may lack names themselves: at most `rounds` rounds.
    """
    defined = definitions(outside).cache()
    spaces = defined.where("kind = 'NAMESPACE'").select(F.col("id").alias("namespace"), "source_file").distinct()
    alone = defined.where("kind <> 'NAMESPACE'").groupBy("id").agg(F.countDistinct("source_file").alias("n"), F.first("source_file").alias("source_file")).where("n = 1")
    found = None
    for _ in range(rounds):
        by_space = missing.where("namespace <> ''").join(spaces, "namespace").select("source_file")
        by_id = missing.where("namespace = ''").join(alone, "id").select("source_file")
        new = by_space.union(by_id).distinct()
        if found is not None:
            new = new.join(found, "source_file", "left_anti")
        if new.isEmpty():
            break
        found = new if found is None else found.union(new).distinct()
        refs = outside.join(new, "source_file", "left_semi").select(F.explode(F.expr(r"regexp_extract_all(text, '<include[^>]*refid\\s*=\\s*[\"\']\\s*([^\"\']*?)\\s*[\"\']', 1)")).alias("ref"))
        missing = refs.select(F.regexp_extract("ref", r"^(.*)\.[^.]+$", 1).alias("namespace"), F.regexp_extract("ref", r"([^.]+)$", 1).alias("id")).join(defined.select("id"), "id", "left_semi").distinct()
    return found if found is not None else outside.select("source_file").limit(0)
