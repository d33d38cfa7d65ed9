"""Table functions for SQL: what the text functions find, a row each, for use with LATERAL.

Each is a query over its argument, so the optimiser puts it into the plan that calls it; a null text
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom import fixed
from ledgerloom.functions import text


def _raw(pattern: str) -> str:
    """A pattern as a SQL string that is read as it is written."""
    return 'r"' + pattern.replace('"', r"\x22") + '"'


_WORDS = r"""size(filter(split({0}, r'[ \t\n\r\f]+'), w -> w <> ''))"""
_PARAGRAPHS = r"""filter(transform(split(t, r'\n{2,}'), x -> trim(x)), p -> length(p) >= 10)"""
_PARTS = f"filter(transform(split(p, {_raw(text.SENTENCE_END)}), x -> trim(x)), s -> s <> '')"
_SENTENCES = f"""filter(flatten(transform({_PARAGRAPHS}, (p, i) -> transform({_PARTS}, (s, j) ->
  named_struct('i', i, 'j', j, 's', s, 'n', {_WORDS.format("s")})))), s -> s.n >= 3)"""
_TERM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x.term)), '^the ', ''), '^a ', ''), '^an ', ''))"


def _matched(pattern: str, first: str, second: str) -> str:
    """The two groups of each match as structs."""
    a, b = (f"regexp_extract_all(t, {_raw(pattern)}, {k})" for k in (1, 2))
    return f"zip_with({a}, {b}, (x, y) -> named_struct('{first}', trim(x), '{second}', trim(y)))"


_DEFINED = f"filter({_matched('(?i)' + fixed.DEFINITION, 'term', 'definition')}, x -> {_WORDS.format('x.term')} <= 6 AND length({_TERM}) >= 3)"
#: name: columns of the rows, what they are selected as, and the array that they come from.
FUNCTIONS = {
    "text_sentences": ("seq INT, paragraph_index INT, sentence_index INT, sentence STRING, words BIGINT", "pos, col.i, col.j, col.s, CAST(col.n AS BIGINT)", _SENTENCES),
    "text_amounts": ("seq INT, amount STRING", "pos, trim(col)", f"regexp_extract_all(t, {_raw('(?i)' + fixed.MONEY)}, 0)"),
    "text_percentages": ("seq INT, percentage STRING", "pos, col", f"regexp_extract_all(t, {_raw(fixed.PERCENT)}, 0)"),
    "text_acronyms": ("seq INT, expansion STRING, acronym STRING", "pos, col.expansion, col.acronym", _matched(fixed.ACRONYM, "expansion", "acronym")),
    "text_definitions": ("seq INT, term STRING, definition STRING", "pos, col.term, col.definition", _DEFINED),
    "text_quoted": ("seq INT, term STRING", "pos, col", f"regexp_extract_all(t, {_raw(fixed.QUOTED_TERM)}, 1)"),
}


def register(spark: SparkSession) -> SparkSession:
    """The session with all table functions: text_sentences(text), text_amounts(text) and the others."""
    for name, (columns, values, array) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE({columns}) RETURN SELECT {values} FROM posexplode({array})")
    return spark
