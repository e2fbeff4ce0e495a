"""Merkle fingerprints of documents, by DataFrame functions alone.

A tree of four levels, built by one rule for texts of any length: pieces, paragraphs, sections, root.

* A piece ends with the line, or after 7 bytes (of UTF-8) where a hash over a window of two characters says so: a character
  has one of four classes by the low six bits of its code point, whatever its script, and a piece ends where a class
  follows the one before it in turn. Without such a place it ends after 64 bytes. It is cut by its content, so
  pieces line up again behind an edit.
* A paragraph ends with the line, or where a piece's digest starts with 0 (about every 16 pieces of a long line).
* A section ends with a blank line, or where a paragraph's digest starts with 0.

A piece's digest is a 64-bit hash of it, a paragraph's or section's the SHA-256 of its children's digests, the root's that
of the sections' and of the whole text's. The fingerprint has six fields, joined by colons: the root (64 hex digits), 8
digits of each section, the number of paragraphs up to each section's end (joined by commas), 8 digits of each paragraph,
the number of pieces up to each paragraph's end, and some digits of each piece: at least 5, more where there are many, so that few
pieces of unrelated texts agree by chance. Equal texts have equal fingerprints; roots test equality; from sections down to
pieces, branches that differ tell where an edit is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import tasks

#: Hex digits kept of a section's or paragraph's digest, and of a piece's at least (see digits_of).
SHORT, PIECE = 8, 5


def _class(k: int, least: int = 0) -> str:
    """The bytes, from `least` on, that end a character of class k, as a regular expression class: by their low six bits, multiplied, shifted and cut (numbers with which also texts of two or four letters have places to cut)."""
    return "[" + "".join(rf"\x{b:02x}" for b in range(least, 0xC0) if b != 10 and ((b & 63) * 51 + 4) % 64 // 16 == k % 4) + "]"


def _pieces() -> str:
    """The regular expression of a piece, over a text's UTF-8 bytes as Latin-1. Between two characters' last bytes stand the second one's first ones, if it has more than one."""
    ends = "|".join(rf"{_class(k)}(?:{_class(k + 1)}|[\xc0-\xff][\x80-\xbf]{{0,2}}?{_class(k + 1, 0x80)})" for k in range(4))
    return rf"[^\n]{{0,6}}\n+|[^\n]{{5,61}}?(?:(?:{ends})(?![\x80-\xbf])|\n+)|[^\n]{{1,64}}"


PIECES = _pieces()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: a lambda's argument isn't expanded where it is used."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _start(ends: Column, k: Column) -> Column:
    """How many children stand before group k (from 0)."""
    return F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))))


def _ends(n: Column, closes: Callable[[Column], Column]) -> Column:
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | closes(i))


def _digests(children: Column, ends: Column) -> Column:
    return F.transform(ends, lambda e, k: F.sha2(F.concat_ws("", F.slice(children, _start(ends, k) + 1, e - _start(ends, k))), 256))


def digits_of(pieces: Column) -> Column:
    """Digits kept of each of so many pieces: two more than their number has, so that of another text's pieces one in 256 at most is there by chance."""
    return F.greatest(F.lit(PIECE), F.ceil(F.log2(F.greatest(pieces, F.lit(1))) / 4).cast("int") + 2)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text of any length; null counts as empty (a root over no sections)."""
    zero = F.lit("0")
    short = lambda a, n: F.concat_ws("", F.transform(a, lambda x: F.substring(x, 1, n)))
    said = lambda ends: F.concat_ws(",", F.transform(ends, lambda x: x.cast("string")))

    def of_pieces(piece: Column) -> Column:
        return let(F.transform(piece, lambda x: F.lpad(F.hex(F.xxhash64(x)), 16, "0")), lambda digest: F.when(F.size(digest) == 0, empty).otherwise(of_digests(piece, digest)))

    def of_digests(piece: Column, digest: Column) -> Column:
        ends = _ends(F.size(digest), lambda i: F.startswith(F.element_at(digest, i), zero) | F.endswith(F.element_at(piece, i), F.lit("\n")))
        return let(ends, lambda e: let(_digests(digest, e), lambda p: of_paragraphs(piece, digest, e, p)))

    def of_paragraphs(piece: Column, digest: Column, ends: Column, paragraph: Column) -> Column:
        closed = _ends(F.size(paragraph), lambda i: F.startswith(F.element_at(paragraph, i), zero) | F.endswith(F.element_at(piece, F.element_at(ends, i)), F.lit("\n\n")))
        return let(closed, lambda c: let(_digests(paragraph, c), lambda s: F.concat_ws(":", F.sha2(F.concat_ws("", s, F.sha2(whole, 256)), 256), short(s, SHORT), said(c), short(paragraph, SHORT), said(ends), short(digest, digits_of(F.size(digest))))))

    empty = F.concat(F.sha2(F.lit(""), 256), F.lit(":::::"))
    whole = F.coalesce(text, F.lit(""))
    return let(F.regexp_extract_all(F.decode(F.encode(whole, "UTF-8"), "ISO-8859-1"), F.lit(PIECES), F.lit(0)), of_pieces)


def _parts(field: Column, digits: int) -> Column:
    return F.regexp_extract_all(field, F.lit(f".{{{digits}}}"), F.lit(0))


def _piece_digests(parts: Column) -> Column:
    """The pieces' digests of a fingerprint's fields; how many digits each has follows from their number, which the last paragraph's end tells."""
    n = F.coalesce(F.element_at(F.split(parts[4], ","), -1).cast("int"), F.lit(1))
    digits = F.floor(F.length(parts[5]) / n).cast("string")
    return F.when(parts[5] == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(parts[5], F.concat(F.lit(".{"), digits, F.lit("}")), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the pieces that both have, by the pieces of both; equal fingerprints 1, and 0 if one is null or of an empty text. Repeated pieces count once; of digests of different lengths the shorter length counts."""
    pieces = lambda x: let(F.split(x, ":"), _piece_digests)
    width = lambda p: F.coalesce(F.length(F.get(p, F.lit(0))), F.lit(16))
    cut = lambda p, n: F.array_distinct(F.when(width(p) == n, p).otherwise(F.transform(p, lambda x: F.substring(x, F.lit(1), n))))
    both = F.struct(pieces(a).alias("a"), pieces(b).alias("b"))
    same = lambda q: F.when(F.size(q["a"]) + F.size(q["b"]) == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(q["a"], q["b"])) / (F.size(q["a"]) + F.size(q["b"])))
    dice = let(both, lambda p: let(F.least(width(p["a"]), width(p["b"])), lambda n: let(F.struct(cut(p["a"], n).alias("a"), cut(p["b"], n).alias("b")), same)))
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(dice)


def tree(fingerprint: Column) -> Column:
    """A fingerprint's levels: struct of sections, section_ends, paragraphs, paragraph_ends, pieces."""
    numbers = lambda x: F.when(x == "", F.array().cast("array<int>")).otherwise(F.split(x, ",").cast("array<int>"))
    return let(F.split(fingerprint, ":"), lambda x: F.struct(_parts(x[1], SHORT).alias("sections"), numbers(x[2]).alias("section_ends"), _parts(x[3], SHORT).alias("paragraphs"), numbers(x[4]).alias("paragraph_ends"), _piece_digests(x).alias("pieces")))


def differing(a: Column, b: Column) -> Column:
    """Where b was edited against a, from the top of the trees down: only children of branches that differ are looked at.

    A struct of numbers from 0: paragraphs_gone, pieces_gone (of a: what b's differing branches lack), paragraphs_new,
    pieces_new (of b), and sections_moved (of b: sections of both texts that stand in another order). All empty if the
    roots agree; null if a or b is.
    """
    at = lambda digests, i: F.element_at(digests, i + 1)
    numbers = lambda x: F.filter(F.sequence(F.lit(-1), F.size(x) - 1), lambda i: i >= 0)
    lacks = lambda held, x: ~F.array_contains(held, x)
    below = lambda groups, ends: F.flatten(F.transform(groups, lambda k: F.sequence(_start(ends, k), F.element_at(ends, k + 1) - 1)))
    none = F.array().cast("array<int>")

    def of_trees(t: Column) -> Column:
        a, b = t["a"], t["b"]
        s = F.struct(F.filter(numbers(a["sections"]), lambda i: lacks(b["sections"], at(a["sections"], i))).alias("a"), F.filter(numbers(b["sections"]), lambda i: lacks(a["sections"], at(b["sections"], i))).alias("b"))
        return let(s, lambda s: of_level(t, s, "paragraphs", "section_ends", lambda p: of_level(t, p, "pieces", "paragraph_ends", lambda q: said(t, p, q))))

    def of_level(t: Column, parents: Column, level: str, ends: str, then: Callable[[Column], Column]) -> Column:
        """The children of the differing parents of both sides that the other side's ones lack."""
        own = F.struct(*[below(parents[k], t[k][ends]).alias(k) for k in "ab"])
        of = lambda k: lambda i: at(t[k][level], i)
        digests = lambda c: F.struct(*[F.transform(c[k], of(k)).alias(k) for k in "ab"])
        unlike = lambda k, h: lambda i: lacks(h[k], at(t["b" if k == "a" else "a"][level], i))
        left = lambda c, h: F.struct(F.filter(c["a"], unlike("b", h)).alias("a"), F.filter(c["b"], unlike("a", h)).alias("b"))
        return let(own, lambda c: let(digests(c), lambda h: let(left(c, h), then)))

    def said(t: Column, paragraphs: Column, pieces: Column) -> Column:
        a, b = t["a"]["sections"], t["b"]["sections"]
        common = F.struct(F.filter(a, lambda x: F.array_contains(b, x)).alias("a"), F.filter(numbers(b), lambda i: F.array_contains(a, at(b, i))).alias("b"))
        moved = let(common, lambda c: F.filter(c["b"], lambda i, k: ~at(b, i).eqNullSafe(F.get(c["a"], k))))
        return F.struct(paragraphs["a"].alias("paragraphs_gone"), paragraphs["b"].alias("paragraphs_new"), pieces["a"].alias("pieces_gone"), pieces["b"].alias("pieces_new"), moved.alias("sections_moved"))

    same = F.struct(*[none.alias(k) for k in ("paragraphs_gone", "paragraphs_new", "pieces_gone", "pieces_new", "sections_moved")])
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, same).otherwise(let(F.struct(tree(a).alias("a"), tree(b).alias("b")), of_trees))


#: How documents follow each other within a range.
def _order() -> WindowSpec:
    return Window.partitionBy("range").orderBy("halo", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def in_ranges(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, text (null: empty), range, halo: each range's documents, and (halo) the first one of the next range, the last range's being that of the first.

    doc_id ranges of about equal counts (from approximate quantiles; a few bounds for each task) are
    windows of their own; each range also gets the first document of the following one. Rows that share a
    doc_id follow each other in the order of their texts. A single document is its own next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    n = 4 * tasks(docs)
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    steps = max(1, len(bounds).bit_length())
    held = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    # the number of bounds below doc_id, by halving
    halve = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: let(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("m")), lambda x: F.when(x["lo"] >= x["hi"], F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).when(F.element_at(held, F.least(x["m"], F.lit(max(len(bounds) - 1, 0))) + 1) < F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.struct((x["m"] + 1).alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct(x["lo"].alias("lo"), x["m"].alias("hi")))),
        lambda s: s["lo"],
    ) if bounds else F.lit(0)
    ranged = rows.withColumn("range", halve)
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"))).alias("first")).orderBy("range").collect()  # a row for each range
    if not firsts:
        return rows.select("doc_id", "text", F.lit(0).alias("range"), F.lit(False).alias("halo"))
    order = [r["range"] for r in firsts]
    target = dict(zip(order[1:] + order[:1], order, strict=True))  # the range that the first row of a range also goes to
    where = docs.sparkSession.createDataFrame([(target[r["range"]], r["range"], r["first"]["d"], r["first"]["h"]) for r in firsts], "`to` int, `of` int, `d` long, `h` long")
    key = F.coalesce(ranged["doc_id"], F.lit(-(1 << 63)))
    halo = ranged.join(F.broadcast(where), (F.col("range") == F.col("of")) & (key == F.col("d")) & (F.xxhash64("text") == F.col("h")))
    halo = halo.select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("halo"))
    return ranged.select("doc_id", "text", F.col("range").cast("int").alias("range"), F.lit(False).alias("halo")).unionByName(halo)


def with_next(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and next_text, the text of the document with the next larger doc_id, after the last the first."""
    following = in_ranges(docs, column).withColumn("next_text", F.lead("text").over(_order())).where(~F.col("halo"))
    return following.select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter (rounded down) of code points replaced by as many of the following text's first, or all."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_edited (paragraphs of the edited text that the text lacks).

    Null texts count as empty; rows that share a doc_id (or have none) each give a row, in the order of their texts' hashes;
    a single document is its own next; an empty table gives no rows. Other columns of docs don't matter.
    """
    rows = in_ranges(docs).withColumn("next_text", F.lead("text").over(_order())).withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(_order())).where(~F.col("halo"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.coalesce("next_text", "text")))
    printed = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), F.coalesce("next_fingerprint", "fingerprint").alias("next_fingerprint"),
    )
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    n_edited = F.size(differing(F.col("fingerprint"), F.col("edited_fingerprint"))["paragraphs_new"]).cast("long")
    return printed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"), n_edited.alias("n_edited"))
