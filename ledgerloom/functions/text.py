"""Text expressions: cleaning, segmentation, tagging, glossary terms, severity, names. All run in the JVM."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
#: Characters that texts hardly hold, round a match and between its groups.
MARK, BETWEEN = "\x01", "\x02"


def whole_word(word: str) -> str:
    """A pattern for word between characters that are no letters, digits or underscores."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"


def any_of(patterns: Iterable[str], flags: str = "") -> str:
    """One pattern for all of them, so a text is searched once; (?U) makes classes know all of Unicode."""
    return f"(?U{flags})" + "|".join(f"(?:{p})" for p in patterns)


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once: a lambda's variable isn't expanded where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether a text holds any of these strings."""
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def literals(patterns: Iterable[str]) -> list[str] | None:
    """Letters of which a text that matches any of the patterns holds some; None if the patterns have more than letters, blanks and word ends."""
    plain = [re.sub(r"\\b|\\s\+|\[\\s\\-\]|[a-z]\?", " ", p) for pattern in patterns for p in pattern.split("|")]
    return [max(p.split(), key=len) for p in plain] if all(re.fullmatch("[a-z ]*[a-z][a-z ]*", p) for p in plain) else None


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in a text; only texts that hold letters of one are searched."""
    found, known = text.rlike(any_of(patterns)), literals(patterns)
    return holds_any(text, known) & found if known else found


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# tags of sentences


def indicators(text: Column, patterns: list[str]) -> Column:
    """The patterns that the text matches whatever its case, in their order; one pattern of them all rules most texts out."""
    each = F.array_compact(F.array(*[F.when(text.rlike(any_of([p], "i")), F.lit(p)) for p in patterns]))
    return F.when(text.rlike(any_of(patterns, "i")), each).otherwise(F.array().cast("array<string>"))


def refers_to_company(text: Column) -> Column:
    return text.rlike(any_of(fixed.COMPANY_REFERENCES, "i"))


def tags(text: Column) -> Column:
    """has_company_coref, is_forward_looking and fl_indicators (the patterns that match) of a sentence."""
    of = lambda found: F.struct(refers_to_company(text).alias("has_company_coref"), (F.size(found) > 0).alias("is_forward_looking"), found.alias("fl_indicators"))
    return let(indicators(text, fixed.FORWARD_LOOKING), of)


# cleaning


def normalise_whitespace(text: Column) -> Column:
    """Control characters to blanks, line ends to \\n, runs of blanks to one, three or more line ends to two, ends trimmed."""
    x = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def unescape(text: Column) -> Column:
    """Character references, by number or name, as the characters; each is read once, unknown ones stay."""
    pattern = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
    names = lookup({k: chr(v) for k, v in html.entities.name2codepoint.items()} | {"apos": "'"})

    def char(e: Column) -> Column:
        number = F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 9), 16, 16)).when(e.startswith("#"), F.conv(F.substring(e, 2, 9), 10, 16))
        legal = number.isNotNull() & (F.length(number) <= 6) & ~number.rlike("^(D[89A-F][0-9A-F]{2}|0)$") & (F.lpad(number, 6, "0") <= "10FFFF")
        return F.when(legal, F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")).otherwise(F.coalesce(names[e], F.concat(F.lit("&"), e, F.lit(";"))))

    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern)
    chars = F.concat(F.transform(found, char), F.array(F.lit("")))
    return F.when(text.contains("&"), F.array_join(F.zip_with(parts, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def strip_html(text: Column) -> Column:
    """Text of a page: scripts, styles and head dropped, breaks and paragraphs as line ends, table cells joined by bars.

    A text without a tag stays as it is.
    """
    x = F.regexp_replace(text, r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|head)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?is)\s*</t[dh]\s*>\s*<t[dh]\b[^>]*>\s*", " | ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>|</tr\s*>", "\n"), r"(?i)</(p|table|div|h[1-6])\s*>", "\n\n")
    return F.when(text.rlike(r"<[a-zA-Z][^>]*>"), unescape(F.regexp_replace(x, r"(?s)<[/a-zA-Z!?][^>]*>", " "))).otherwise(text)


def remove_boilerplate(text: Column, header_only: bool = False) -> Column:
    """Text without the boilerplate patterns; header_only drops the forward-looking heading on lines of its own alone."""
    patterns = list(fixed.BOILERPLATE)
    if header_only:
        patterns[1] = r"(?im)^\s*forward[- ]looking statements?\s*$"
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def clean(text: Column, header_only: bool = False) -> Column:
    return remove_boilerplate(normalise_whitespace(strip_html(text)), header_only)


def item_1a(raw: Column, least: int = 50) -> Column:
    """The risk section of a raw filing: from its last heading Item 1A to the next of Item 1B or 2; null unless over least words.

    Of the filing its first document is read, without tags if it has any.
    """
    document = F.regexp_extract(raw, r"(?is)<DOCUMENT>(.*?)(?:</DOCUMENT>|\z)", 1)
    document = F.when(raw.rlike("(?i)<DOCUMENT>"), document).otherwise(raw)
    marked = document.rlike("(?i)<xml>|<type>xml|<html>|10k.htm|<XBRL>")
    plain = F.when(marked, unescape(F.regexp_replace(F.regexp_replace(document, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<[^>]*>", "\n"))).otherwise(document)
    lines = F.filter(F.transform(F.split(plain, "\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "\t", " "), r"^\s+", "")), lambda x: x != "")

    def cut(v: Column) -> Column:
        at = lambda p: F.filter(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1))), lambda i: F.coalesce(F.get(v, i - 1).rlike(p), F.lit(False)))
        start = F.array_max(at(r"(?i)^Item\s*1A\b"))
        ends = at(r"(?i)^Item\s*(1B|2)\b")
        end = F.coalesce(F.array_min(F.filter(ends, lambda e: e > start)), F.size(v) + 1)
        whole = F.regexp_replace(F.array_join(F.slice(v, start, end - start), " "), r"\s{2,}", " ")
        return F.when(start.isNotNull() & (F.size(ends) > 0), whole)

    section = let(lines, cut)
    return F.when(F.size(F.regexp_extract_all(section, F.lit(r"\S+"), F.lit(0))) > least, section)


# paragraphs and sentences


def paragraphs(text: Column) -> Column:
    """Parts between blank lines of ten characters or more."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: F.trim(x)), lambda p: F.length(p) >= 10)


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[ \t\n\r\f]+"), "")).cast("long")


def sentences(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """key, seq, paragraph_index, sentence_index, text, word_count and tags of each sentence of least words or more."""
    trimmed = lambda p: F.filter(F.transform(F.split(p, SENTENCE_END), lambda x: F.trim(x)), lambda s: s != "")

    def numbered(p: Column, i: Column) -> Column:
        return F.transform(trimmed(p), lambda s, j: F.struct(i.alias("paragraph_index"), j.alias("sentence_index"), s.alias("text"), word_count(s).alias("word_count")))

    found = F.filter(F.flatten(F.transform(paragraphs(F.col(text)), numbered)), lambda s: s["word_count"] >= least)
    rows = df.select(key, F.posexplode(found).alias("seq", "s"))
    return rows.select(key, "seq", "s.*").withColumn("tags", tags(F.col("text")))


def sentence_id(accession: Column, section: Column, seq: Column) -> Column:
    return F.format_string("%s_%s_%04d", accession.cast("string"), section.cast("string"), seq)


def section_id(cik: Column, accession: Column, section: Column) -> Column:
    return F.format_string("%s_%s_%s", cik.cast("string"), accession.cast("string"), section.cast("string"))


# names, codes and dates


def slugify(text: Column, most: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_")), 1, most)


def cik(value: Column) -> Column:
    """A company's number without leading zeros; null where it is none."""
    return F.trim(value.cast("string")).try_cast("bigint").cast("string")


def accession_clean(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9a-zA-Z]", "")


def company_name(value: Column) -> Column:
    """Upper case, blanks in runs as one."""
    return F.regexp_replace(F.upper(value), " {2,}", " ")


def item_code(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, fixed.ITEM_CODE, 1), F.lit(""))


def item_category(code: Column) -> Column:
    return F.coalesce(lookup(fixed.ITEM_CATEGORIES)[code], F.lit("other"))


def market_code(name: Column) -> Column:
    return F.coalesce(lookup(fixed.MARKET_CODES)[F.lower(F.trim(name))], F.substring(F.upper(name), 1, 4))


def country_code(name: Column) -> Column:
    return lookup(fixed.COUNTRY_CODES)[F.upper(F.trim(name))]


def market_kind(name: Column) -> Column:
    """region for regions and names without a country's code, else country."""
    region = F.upper(F.trim(name)).isin(fixed.REGIONS) | country_code(name).isNull()
    return F.when(region, "region").otherwise("country")


def fiscal_year(date: Column) -> Column:
    """The year, or the one before for January to March."""
    return (F.year(date) - F.when(F.month(date) <= 3, 1).otherwise(0)).cast("long")


def last_days(today: Column, n: int) -> Column:
    """The n days before a day and the day itself."""
    return F.sequence(F.date_sub(today, n), today)


def coerced(value: Column, allowed: list[str], default: str) -> Column:
    """value where it is one of those allowed, else the default."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


# glossary


def normalise_term(term: Column) -> Column:
    """Lower case, without a leading the, a and an, in turn."""
    return F.trim(F.regexp_replace(F.lower(F.trim(term)), "^(?:the )?(?:a )?(?:an )?", ""))


def pairs_of(text: Column, pattern: str, first: str, second: str) -> Column:
    """Structs of the two groups of each match of a pattern.

    A text is searched once: its matches are put between marks and cut out; only texts that hold a mark are searched for each group.
    """
    pair = lambda x, y: F.struct(F.trim(x).alias(first), F.trim(y).alias(second))
    a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    odd = F.filter(F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$1{BETWEEN}$2{MARK}")), MARK), lambda x, i: i % 2 == 1)
    once = F.transform(F.transform(odd, lambda x: F.split(x, BETWEEN)), lambda x: pair(x[0], x[1]))
    return F.when(holds_any(text, (MARK, BETWEEN)), F.zip_with(a, b, pair)).otherwise(once)


def acronyms(text: Column) -> Column:
    """Structs of expansion and acronym for each `Expansion Words (ACR)`."""
    return pairs_of(text, fixed.ACRONYM, "expansion", "acronym")


def definitions(text: Column, pattern: str = "(?i)" + fixed.DEFINITION) -> Column:
    """Structs of term and definition; terms of over six words, or of under three characters once normalised, are left out."""
    found = pairs_of(text, pattern, "term", "definition")
    return F.filter(found, lambda p: (word_count(p["term"]) <= 6) & (F.length(normalise_term(p["term"])) >= 3))


def quoted_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.QUOTED_TERM), F.lit(1))


def glossary(df: DataFrame, key: str, text: str, pattern: str, group: int = 1) -> DataFrame:
    """term, frequency and documents of all matches of a pattern's group, by normalised term of three characters or more."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("raw"))
    found = found.select(key, normalise_term(F.col("raw")).alias("term")).where(F.length("term") >= 3)
    return found.groupBy("term").agg(F.count("*").alias("frequency"), F.countDistinct(key).alias("documents"))


def domain_tags(text: Column, domains: dict[str, list[str]] | None = None) -> Column:
    """Domains of which any keyword is in the text, or other."""

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(holds_any(low, keys), F.lit(d)) for d, keys in (domains or fixed.DOMAINS).items()]))

    return let(let(F.lower(text), found), lambda x: F.when(F.size(x) == 0, F.array(F.lit("other"))).otherwise(x))


# severity and changes


def severity(text: Column, high: list[str] = fixed.HIGH_SEVERITY, medium: list[str] = fixed.MEDIUM_SEVERITY) -> Column:
    """HIGH, MED or LOW by the first list with a pattern that matches the text in lower case."""
    return let(F.lower(text), lambda low: F.when(matches_any(low, high), "HIGH").when(matches_any(low, medium), "MED").otherwise("LOW"))


def severity_rank(value: Column) -> Column:
    return F.when(value == "HIGH", 0).when(value == "MED", 1).when(value == "LOW", 2)


def overall(severities: Column) -> Column:
    """The gravest of a group, NONE for an empty one."""
    rank = F.min(severity_rank(severities))
    return F.when(rank == 0, "HIGH").when(rank == 1, "MED").when(rank == 2, "LOW").otherwise("NONE")


def reason(text: Column, change: Column) -> Column:
    """Why a changed sentence matters: the first rule that matches, else by the kind of change."""

    def of(low: Column) -> Column:
        (first, *rest) = fixed.REASONS
        chain = F.when(matches_any(low, [first[0]]), first[1])
        for pattern, words in rest:
            chain = chain.when(matches_any(low, [pattern]), words)
        return chain.when(change == "added", fixed.REASON_ADDED).otherwise(fixed.REASON_OTHER)

    return let(F.lower(text), of)


# figures in sentences


def amounts(text: Column) -> Column:
    """Money amounts as written."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + fixed.MONEY), F.lit(0)), lambda x: F.trim(x))


def percentages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.PERCENT), F.lit(0))


def metric_names(text: Column) -> Column:
    """For each money amount the three words before it, from at most 40 characters; revenue where there are none.

    No more than 40 amounts fit into 40 characters, so no more of what stands before is put together for each, and nothing
    where what stands between two amounts is long enough.
    """
    pattern = "(?i)" + fixed.MONEY

    def names(v: Column) -> Column:
        parts, found = v["parts"], v["found"]

        def name(m: Column, i: Column) -> Column:
            own = F.get(parts, i)
            start = F.greatest(i - 39, F.lit(1))
            near = F.zip_with(F.slice(parts, start, i + 2 - start), F.slice(found, start, i + 1 - start), lambda p, a: F.concat(p, F.coalesce(a, F.lit(""))))
            before = F.when(F.length(own) >= 40, own).otherwise(F.array_join(near, ""))
            context = F.concat(F.right(before, F.lit(40)), m)
            words = F.filter(F.split(F.call_function("substring_index", context, F.trim(m), F.lit(1)), r"(?U)\s+"), lambda w: w != "")
            last = F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3)
            return F.coalesce(F.nullif(F.regexp_replace(F.array_join(last, " "), r"^[.,;:()]+|[.,;:()]+$", ""), F.lit("")), F.lit("revenue"))

        return F.transform(found, name)

    # an amount begins with a dollar
    return F.when(text.isNull() | text.contains("$"), let(F.struct(F.split(text, pattern).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), names)).otherwise(F.array().cast("array<string>"))


def direction(text: Column) -> Column:
    low = F.lower(text)
    return F.when(holds_any(low, fixed.INCREASE_WORDS), "increase").when(holds_any(low, fixed.DECREASE_WORDS), "decrease").otherwise("not_stated")


def sentiment(text: Column) -> Column:
    low = F.lower(text)
    return F.when(holds_any(low, fixed.POSITIVE_WORDS), "positive").when(holds_any(low, fixed.CAUTIOUS_WORDS), "cautious").otherwise("neutral")


def is_self_reference(name: Column, company: Column) -> Column:
    """Whether a name is a word for the company itself or shares a word with its name."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.lower(name).isin(fixed.SELF_REFERENCES) | F.arrays_overlap(words(name), words(company))


# answers of language models


def without_fences(text: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json|cypher|sql)?\s*", ""), r"\s*```$", ""))


def first_object(text: Column) -> Column:
    """The JSON object in an answer: the whole of it, or else from the first brace to the last."""
    plain = without_fences(text)
    whole = F.when(F.try_parse_json(plain).isNotNull(), plain)
    part = F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(whole, F.when(F.try_parse_json(part).isNotNull(), part))
