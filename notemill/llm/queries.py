"""Queries of the subpackage and the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..sqltext import sql_norm, sql_trim
from . import distinct, frequency, lookalike, markup, neardup, packing, tokens

Query = Callable[[SparkSession, str], DataFrame]

_TERMS = f"""
occ AS (
  SELECT note_id, {sql_norm("t.term")} AS term FROM (SELECT note_id, unnest(terms) AS t FROM notes) WHERE t.term IS NOT NULL)"""

P3_SQL = f"""
WITH {_TERMS},
attr AS (
  SELECT note_id, {sql_norm("k")} || '=' || {sql_norm("v")} AS item
  FROM (SELECT note_id, k, unnest(attributes[k]) AS v FROM (SELECT note_id, attributes, unnest(map_keys(attributes)) AS k FROM notes))
  WHERE {sql_trim("v")} <> ''),
items AS (SELECT note_id, 'term' AS item_kind, term AS item FROM occ UNION ALL SELECT note_id, 'attribute', item FROM attr),
counts AS (
  SELECT item_kind, item, count(*) AS n_occurrences, count(DISTINCT note_id) AS n_notes,
    CASE WHEN count(DISTINCT note_id) < 3 THEN 'rare' WHEN count(DISTINCT note_id) > 0.3 * (SELECT count(*) FROM notes) THEN 'common' END AS mark
  FROM items GROUP BY item_kind, item)"""

P5_SQL = f"""
WITH {_TERMS},
tf AS (SELECT note_id, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS n_notes FROM tf GROUP BY term),
dl AS (SELECT note_id, count(*) AS dl FROM occ GROUP BY note_id),
st AS (SELECT (SELECT count(*) FROM notes)::DOUBLE AS n, (SELECT count(*) FROM occ)::DOUBLE / (SELECT count(*) FROM notes) AS av),
scored AS (
  SELECT note_id, term, tf::INT AS tf, n_notes,
    ln(1 + (n - n_notes + 0.5::DOUBLE) / (n_notes + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) AS score
  FROM tf JOIN df USING (term) JOIN dl USING (note_id), st)"""

P6_SETS = f"""
WITH {_TERMS},
s AS (SELECT DISTINCT note_id, term FROM occ),
size AS (SELECT note_id, count(*) AS n FROM s GROUP BY note_id),
meet AS (SELECT x.note_id AS note_a, y.note_id AS note_b, count(*) AS shared FROM s x JOIN s y ON x.term = y.term AND x.note_id < y.note_id GROUP BY ALL),
pairs AS (
  SELECT note_a, note_b FROM meet JOIN size p ON p.note_id = note_a JOIN size q ON q.note_id = note_b
  WHERE shared * 100 >= (p.n + q.n - shared) * 70)"""




def _look(text: str) -> str:
    """SQL of the form that a text has in common with all that look like it."""
    emoji = lookalike.EMOJI
    x = text
    for _ in range(2):  # matches overlap
        x = f"regexp_replace({x}, '([{emoji}][\\x{{FE0F}}\\x{{20E3}}]?)\\x{{200D}}([{emoji}])', '\\1{lookalike.JOINER}\\2', 'g')"
    for mark, chars in lookalike.marks_left_out().items():
        x = f"regexp_replace({x}, '([{chars}])', '\\1{mark}', 'g')"
    old, new = ("".join(f"' || chr({ord(c)}) || '" if ord(c) < 32 or c == "'" else c for c in y) for y in lookalike.single_characters())
    x = f"translate({x}, '{old}', '{new}')"
    for c in map(chr, range(0xFB00, 0xFB07)):
        x = f"replace({x}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    return f"nfc_normalize({x})"


P9_SQL = f"""
WITH m AS (SELECT doc_id, text, {_look("text")} AS look FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b
FROM m a JOIN m b ON a.look = b.look AND a.text <> b.text AND a.doc_id < b.doc_id WHERE {sql_trim("a.look")} <> ''"""

P6_GROUPS_SQL = f"""
WITH RECURSIVE {P6_SETS.split("WITH", 1)[1]},
sets AS (SELECT note_id, string_agg(term, chr(0) ORDER BY term) AS terms FROM s GROUP BY note_id),
cls AS (SELECT note_id, min(note_id) OVER (PARTITION BY terms) AS class_id FROM sets),
linked AS (
  SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM pairs JOIN cls x ON x.note_id = note_a JOIN cls y ON y.note_id = note_b WHERE x.class_id <> y.class_id),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT DISTINCT class_id AS c, class_id AS d FROM cls UNION SELECT reach.c, edges.b FROM reach JOIN edges ON edges.a = reach.d),
grp AS (SELECT c, min(d) AS group_id FROM reach GROUP BY c),
deg AS (SELECT a AS c, count(*) AS n_links FROM edges GROUP BY a)
SELECT note_id, class_id, group_id, coalesce(n_links, 0)::BIGINT AS n_links FROM cls JOIN grp ON grp.c = class_id LEFT JOIN deg ON deg.c = class_id"""


def _on(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


def _rounded_scores(notes: DataFrame) -> DataFrame:
    return distinct.distinctive_terms(notes).selectExpr("note_id", "term", "tf", "n_notes", "round(score, 6) AS score")


QUERIES: dict[str, Query] = {
    "p2_found": _on(markup.markup_found, "documents", "notes"),
    "p2_clean": _on(markup.clean_texts, "documents", "notes"),
    "p3_found": _on(frequency.marked_items, "notes"),
    "p3_counts": _on(frequency.item_counts, "notes"),
    "p5_found": _on(distinct.characteristic_terms, "notes"),
    "p5_scores": _on(_rounded_scores, "notes"),
    "p6_found": _on(neardup.near_duplicate_pairs, "notes"),
    "p6_groups": _on(neardup.near_duplicate_groups, "notes"),
    "p7_ids": _on(tokens.token_ids, "documents"),
    "p8_assignments": _on(packing.pack_documents, "documents", "containers"),
    "p8_report": _on(packing.packing_report, "documents", "containers"),
    "p9_found": _on(lookalike.look_alike_pairs, "documents"),
    "p9_forms": _on(lookalike.canonical_forms, "documents"),
}
ORACLE: dict[str, str] = {
    "p3_found": P3_SQL + " SELECT item_kind, item, mark FROM counts WHERE mark IS NOT NULL",
    "p3_counts": P3_SQL + " SELECT * FROM counts",
    "p5_found": P5_SQL + " SELECT note_id, term FROM scored WHERE tf >= 4 AND n_notes <= 5",
    "p5_scores": P5_SQL + " SELECT note_id, term, tf, n_notes, round(score, 6) AS score FROM scored",
    "p6_found": P6_SETS + " SELECT * FROM pairs",
    "p6_groups": P6_GROUPS_SQL,
    "p9_found": P9_SQL,
}
