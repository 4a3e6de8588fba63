"""Visually identical text with different characters.

Method: look-alike characters are mapped in SQL; texts are grouped by the mapped value under an
accent-sensitive, case-sensitive Unicode collation, in which composed and decomposed accents are equal; of
each class a deterministic canonical member is chosen and joined back. The collation also holds visibly different
characters equal (the digits of all scripts, most marks of one kind of place, styles of mathematical letters, the tags
that tell flags apart), so the composed forms of what it groups are compared exactly.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..common import WHITE, block_pairs, cut, few, salted_join, spread

# Letters and marks of other scripts that are drawn like a Latin letter or ASCII mark.
LOOK_ALIKE = [
    ("АВЕКМНОРСТУХЅІЈҮԌԚԜЁЇ", "ABEKMHOPCTYXSIJYGQWËÏ"),  # Cyrillic capitals
    ("аеорсухѕіјһԁԛԝӏёї", "aeopcyxsijhdqwlëï"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capitals
    ("ονϲϳ", "ovcj"),  # Greek small letters
    ("օɑɡ", "oag"),  # Armenian and phonetic small letters
    (";·․∶꞉⁄∕∣ǀǃ∗∼", ";·.:://||!*~"),  # marks
    ("‐‑‒⁃−˗﹣", "-------"),  # hyphens
]
# First and last of the ranges of characters without any look.
INVISIBLE = [
    (0x0, 0x8), (0xE, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0100, 0xE01EF),
]
# Blocks with emoji, as a Java character class without brackets.
EMOJI = r"\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}"
#: Stands for a joiner inside an emoji, which is visible; a private-use character that collation keeps apart.
JOINER = "\ue000"


@cache
def _mapped_pairs() -> dict[str, str]:
    """LOOK_ALIKE and, by rule, blanks of any kind, the full-width and half-width forms, the compatibility ideographs, the
    radicals and the Kelvin, Angstrom and Ohm signs, which become their compatibility forms."""
    pairs = {a: b for old, new in LOOK_ALIKE for a, b in zip(old, new, strict=True)}
    pairs |= {c: " " for c in WHITE if unicodedata.category(c) == "Zs"}
    for low, high in ((0x2126, 0x2126), (0x212A, 0x212B), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0xFF01, 0xFFEE)):
        for c in map(chr, range(low, high + 1)):
            form = unicodedata.normalize("NFKC", c)
            if len(form) == 1 and form != c and c not in "\uffa0\uffe3":
                pairs[c] = form
    for c in map(chr, range(sys.maxunicode + 1)):  # canonically the same as one other character
        form = unicodedata.normalize("NFD", c) if unicodedata.decomposition(c)[:1] not in ("", "<") else ""
        if len(form) == 1 and c not in pairs:
            pairs[c] = pairs.get(form, form)
    return pairs


@cache
def composed_characters() -> dict[str, str]:
    """Every character whose canonical decomposition begins with a mapped one, and the composed form of the mapped one with its marks.

    So mapping a composed and a decomposed text gives canonically equivalent texts.
    """
    pairs, found = _mapped_pairs(), {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            parts = unicodedata.normalize("NFD", c)
            if parts[0] in pairs and c not in pairs:
                found[c] = unicodedata.normalize("NFC", pairs[parts[0]] + parts[1:])
    return found


def single_characters() -> tuple[str, str]:
    """Two strings for SQL's `translate`: each character of the first becomes the one at its place in the
    second, or nothing where the second has ended.

    Invisible characters end the first string. Of `composed_characters` each has the first character of its
    form here; the marks of those that have no composed form are put behind it by `mapped`.
    """
    pairs = _mapped_pairs() | {c: form[0] for c, form in composed_characters().items()}
    gone = "".join(chr(c) for low, high in INVISIBLE for c in range(low, high + 1) if chr(c) not in pairs)
    return "".join(pairs) + gone, "".join(pairs.values())


def marks_left_out() -> dict[str, str]:
    """The marks that `single_characters` leaves out, each with the characters that have it."""
    marks: dict[str, str] = {}
    for c, form in composed_characters().items():
        if form[1:]:
            marks[form[1:]] = marks.get(form[1:], "") + c
    return marks


def _class(chars: str, gap: int = 1) -> str:
    """A Java character class without brackets of `chars`, and of what lies in gaps shorter than `gap` between them."""
    points, ranges = sorted(map(ord, set(chars))), []
    for p in points:
        if ranges and p - ranges[-1][1] <= gap:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def residue(text: Column) -> Column:
    """What of a text is neither a visible ASCII character nor a common blank: the little that decides what has to be mapped."""
    return F.regexp_replace(text, r"[\x09-\x0D\x20-\x7E]+", "")


def mapped(text: Column, odd: Column | None = None) -> Column:
    """`text` with look-alikes, blanks, hyphens and ligatures in one form and invisible characters removed.

    All in JVM expressions. Case, accents, raised, lowered and circled digits and joiners inside emoji stay. `odd` is
    the `residue` of the text; texts without anything to map there are done.
    """
    odd = residue(text) if odd is None else odd
    old, new = single_characters()
    ligatures = [chr(c) for c in range(0xFB00, 0xFB07)]
    marks = marks_left_out()
    touched = _class(old + "\u200d" + "".join(ligatures) + "".join(marks.values()), 4)
    marked = F.regexp_replace(text, f"(?<=[{EMOJI}][\\x{{FE0F}}\\x{{20E3}}]?)\\x{{200D}}(?=[{EMOJI}])", JOINER)
    joined = F.when(F.contains(odd, F.lit("\u200d")), marked).otherwise(text)
    x = joined
    for mark, chars in marks.items():
        x = F.regexp_replace(x, f"[{chars}]", f"$0{mark}")
    x = F.when(odd.rlike(f"[{_class(''.join(marks.values()), 0x30)}]") & odd.rlike(f"[{''.join(marks.values())}]"), x).otherwise(joined)
    x = F.translate(x, old, new)
    for c in ligatures:
        x = F.replace(x, F.lit(c), F.lit(unicodedata.normalize("NFKC", c)))
    return F.when((odd == "") | ~odd.rlike(f"[{touched}]"), text).otherwise(x)


# First and last of the ranges beyond ASCII whose characters a fingerprint may keep: Cyrillic, Armenian, Hebrew,
# Arabic, Thai, Georgian, ideographs. Few ranges, since a pattern tries them one after the other.
FINGERPRINTED = [(0x410, 0x44F), (0x531, 0x58A), (0x5D0, 0x5EA), (0x620, 0x6BF), (0xE01, 0xE46), (0x10A0, 0x10FF), (0x4E00, 0x9FFF)]


@cache
def _variable() -> str:
    """A Java class of what a fingerprint leaves out beyond ASCII: all but characters of these ranges that do not compose."""
    stays = lambda c: unicodedata.category(c)[0] != "M" and unicodedata.normalize("NFD", c) == c
    kept = "".join(c for low, high in FINGERPRINTED for c in map(chr, range(low, high + 1)) if stays(c))
    return f"[^{_class(kept)}]"


def fingerprint(look: Column) -> Column:
    """A hash of the characters of a mapped text that no composition changes: texts that look the same have one fingerprint.

    Blanks go, and letters with marks. ASCII characters and the others are kept apart, so the longer pattern sees the
    `residue` alone.
    """
    base = F.when(look.rlike(r"\p{M}"), F.regexp_replace(look, r"(?s).\p{M}+", "")).otherwise(look)
    ascii_only = F.octet_length(look) == F.length(look)
    others = F.when(ascii_only, "").otherwise(F.regexp_replace(residue(base), f"{_variable()}+", ""))
    return F.xxhash64(F.regexp_replace(base, r"[^\x21-\x7E]+", ""), others)


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _hash1(text: str) -> Column:
    return F.xxhash64(text)


def _hash2(text: str) -> Column:
    return F.xxhash64(F.lit(31), text, F.length(text))


def text_hashes(documents: DataFrame) -> DataFrame:
    """`(doc_id, t1, t2, fp)` of texts with a visible character: a 128-bit hash of the text and a fingerprint.

    Texts that look the same have one fingerprint. The explodes keep the residue and the mapping from being
    computed again.
    """
    rows = spread(documents.select("doc_id", "text")).select("doc_id", "text", F.explode(F.array(residue(F.col("text")))).alias("odd"))
    rows = rows.select("doc_id", "text", F.explode(F.array(mapped(F.col("text"), F.col("odd")))).alias("look"))
    return rows.where(F.col("look").rlike(r"(?U)\S")).select(
        "doc_id", _hash1("text").alias("t1"), _hash2("text").alias("t2"), fingerprint(F.col("look")).alias("fp")
    )


def equivalent_texts(documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """`(t1, t2, n_docs, c1, c2, class_texts)`: the distinct texts that look like another one.

    n_docs is the number of documents with the text, c1 and c2 are the hashes of the class's canonical
    member, class_texts is the number of texts in the class. Hashes alone are grouped first; only texts that
    share a fingerprint with a different text are read again, by their ids, mapped and grouped by collation, together
    with their composed forms, which compare exactly. A third of all texts may share a fingerprint.
    """
    texts = hashes.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"))
    texts = cut(texts)
    several = texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    near = few(cut(salted_join(texts, several, ["fp"], "n").drop("n").withColumnRenamed("doc_id", "d")))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (_hash1("text") == F.col("t1")) & (_hash2("text") == F.col("t2"))
    read = documents.select("doc_id", "text").join(near, same)
    read = read.dropDuplicates(["t1", "t2"]).select("t1", "t2", "n_docs", "fp", "text", F.explode(F.array(mapped(F.col("text")))).alias("look"))
    plain = F.struct(F.length(F.regexp_replace("text", r"[\x00-\x7E]", "")).alias("odd"), F.length("text").alias("len"), "t1", "t2")
    seen, form = F.collate("look", "UNICODE").alias("seen"), F.xxhash64(_composed("look")).alias("form")
    read = cut(read.select("t1", "t2", "n_docs", "fp", seen, form, plain.alias("plain")))
    found = read.groupBy("fp", "seen", "form").agg(F.count(F.lit(1)).alias("class_texts"), F.min("plain").alias("best"))
    found = found.where("class_texts > 1").select("fp", "seen", "form", "class_texts", F.col("best.t1").alias("c1"), F.col("best.t2").alias("c2"))
    return read.join(found, ["fp", "seen", "form"]).select("t1", "t2", "n_docs", "c1", "c2", "class_texts")


def _classified(documents: DataFrame) -> DataFrame:
    """`(doc_id, t1, t2, cls, canonical, class_texts, n)`, one row per document that looks like another one: the class by name,
    whether its text is the canonical one, and the class's texts and documents. One text may have a third of all rows."""
    hashes = cut(text_hashes(documents))
    texts = cut(equivalent_texts(documents, hashes))
    texts = texts.withColumn("cls", F.concat_ws(":", "c1", "c2"))
    sizes = texts.groupBy("cls").agg(F.sum("n_docs").alias("n"))
    texts = texts.join(sizes, "cls").withColumn("canonical", (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")))
    rows = salted_join(hashes.select("doc_id", "t1", "t2"), few(cut(texts)), ["t1", "t2"], "n_docs")
    return cut(rows.select("doc_id", "t1", "t2", "cls", "canonical", "class_texts", "n"))


#: Documents of a class that meet in one join group; larger classes are cut into blocks.
BLOCK = 2_000


def look_alike_pairs(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(doc_a, doc_b)`, doc_a < doc_b, distinct: documents whose texts differ as strings and look the same.

    Null and blank texts and texts of invisible characters alone are in no pair; copies of one text are no
    pair with each other and pair with every document of the class that differs, which is the definition.
    `canonical_forms` has the form that stays linear.
    """
    m = _classified(documents)
    links = m.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b")).distinct()
    pairs = block_pairs(links, m.select(F.col("cls").alias("grp"), "doc_id", "t1", "t2"), block)
    differ = (F.col("a_t1") != F.col("b_t1")) | (F.col("a_t2") != F.col("b_t2"))
    both = (F.col("a_doc_id"), F.col("b_doc_id"))
    return pairs.where(differ & (both[0] != both[1])).select(F.least(*both).alias("doc_a"), F.greatest(*both).alias("doc_b")).distinct()


def canonical_forms(documents: DataFrame) -> DataFrame:
    """`(doc_id, canonical_id, class_texts, form)`: one row per row of documents.

    form is the text of the canonical member: of the class's texts the one with the fewest characters
    beyond ASCII, then the shortest, then by hash. canonical_id is the least document with that text. A text
    that looks like no other is its own form, with class_texts 1 and canonical_id null; null stays null. Only the texts of
    canonical members move; the others stay where they are read.
    """
    m = _classified(documents)
    docs = documents.select("doc_id", "text", _hash1("text").alias("t1"), _hash2("text").alias("t2"))
    first = few(cut(m.where("canonical").groupBy("cls", "n").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("f"))))
    first = first.select("cls", "n", F.col("f.doc_id").alias("canonical_id"), F.col("f.t1").alias("f1"), F.col("f.t2").alias("f2"))
    held = docs.join(first, F.col("doc_id").eqNullSafe(F.col("canonical_id")) & (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")))
    held = held.select("cls", "n", "canonical_id", F.col("text").alias("form")).dropDuplicates(["cls"])
    members = salted_join(m.select("doc_id", "class_texts", "cls"), held, ["cls"], "n").select("doc_id", "canonical_id", "class_texts", "form")
    classed = few(cut(m.select(F.col("doc_id").alias("d"), F.col("t1").alias("d1"), F.col("t2").alias("d2")).distinct()))
    one = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2"))
    rest = docs.join(classed, one, "left_anti")
    return rest.select("doc_id", F.lit(None).cast(m.schema["doc_id"].dataType).alias("canonical_id"), F.lit(1).cast("long").alias("class_texts"), F.col("text").alias("form")).unionByName(members)
