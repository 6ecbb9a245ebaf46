"""Text functions as column expressions: normalisation, terms, ids, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions.lexicon import DEFAULT, Lexicon

#: White space as JavaScript sees it, bullets, a term.
SPACES = r"[\s\x0B ﻿  -     　]+"
#: Runs of white space other than one plain space, which is most of them and stays as it is;
#: most characters are dismissed by the first range.
RUNS = rf"(?=[^!-~])(?: (?=[^!-~]){SPACES}|(?! ){SPACES})"
BULLETS = "[•·◦●]"
TERM = r"[a-z0-9]+(?:-[a-z0-9]+)?"
SENTENCE_END = r"(?<=[.!?])\s+"


def strings(words) -> Column:
    """An array literal."""
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def compact(text: Column) -> Column:
    """White space collapsed, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " "))


def normalize(text: Column) -> Column:
    """Bullets become spaces, then ``compact``."""
    return compact(F.regexp_replace(text, rf"(?=[^!-~]){BULLETS}", " "))


def text_hash(text: Column) -> Column:
    """SHA-1 of the compacted text."""
    return F.sha1(compact(text))


def word_terms(text: Column) -> Column:
    """Distinct lower-case terms of three characters or more, with singulars of those in s."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.length(t) > 2)
    both = F.transform(found, lambda t: F.when(t.endswith("s") & (F.length(t) > 4), F.array(t, t.substr(F.lit(1), F.length(t) - 1))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(both))


def question_terms(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``word_terms`` without stop words."""
    return F.array_except(word_terms(text), strings(lexicon.stop))


def expanded_terms(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """``question_terms`` with expansions. The keys are tried in order, each against the
    terms as grown so far or as part of the text, so an expansion can set off later keys."""
    lowered = F.lower(text)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), strings(words).alias("terms")) for k, words in lexicon.expansions])
    grown = F.aggregate(entries, question_terms(text, lexicon), lambda acc, e: F.when(F.array_contains(acc, e["key"]) | F.contains(lowered, e["key"]), F.array_union(acc, e["terms"])).otherwise(acc))
    return F.array_except(grown, strings(lexicon.stop))


def expanded_text(text: Column, lexicon: Lexicon = DEFAULT, lead: str = "\nRelevant alternate wording: ") -> Column:
    """The question with at most 40 further terms, sorted."""
    more = F.slice(F.array_sort(F.array_except(expanded_terms(text, lexicon), question_terms(text, lexicon))), 1, 40)
    return F.when(F.size(more) == 0, text).otherwise(F.concat(text, F.lit(lead), F.array_join(more, ", ")))


def question_profile(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A struct of the sorted expanded terms and six flags."""
    lowered = F.lower(text)
    has = lambda flag: F.exists(strings(lexicon.flag_phrases[flag]), lambda p: F.contains(lowered, p))
    terms = expanded_terms(text, lexicon)
    flags = {flag: has(flag) for flag in lexicon.flag_phrases}
    flags["asks_conflict"] = flags["asks_conflict"] | F.arrays_overlap(terms, strings(lexicon.conflict))
    flags["asks_explanation"] = flags["asks_explanation"] | lowered.startswith("why")
    return F.struct(F.array_sort(terms).alias("expanded_terms"), *[v.alias(k) for k, v in flags.items()])


def settled_terms(spark: SparkSession, question: str, lexicon: Lexicon = DEFAULT) -> Column:
    """``expanded_terms`` of one question as a literal, so that no row repeats the fold."""
    return strings(spark.range(1).select(expanded_terms(F.lit(question), lexicon)).first()[0])


def settled_profile(spark: SparkSession, question: str, lexicon: Lexicon = DEFAULT) -> Column:
    """``question_profile`` of one question as a literal."""
    found = spark.range(1).select(question_profile(F.lit(question), lexicon)).first()[0].asDict()
    return F.struct(strings(found.pop("expanded_terms")).alias("expanded_terms"), *[F.lit(v).alias(k) for k, v in found.items()])


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, 60 characters at most."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "['’]", ""), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60)
    return F.when(s == "", "unknown").otherwise(s)


def entity_id(type_: Column, name: Column) -> Column:
    return F.concat(F.lower(type_), F.lit(":"), slug(name))


def document_id(season: Column, episode: Column) -> Column:
    """``s01e02`` of numbers, never cut short."""
    return F.format_string("s%02de%02d", season.cast("long"), episode.cast("long"))


def chunk_id(document: Column, number: Column) -> Column:
    return F.concat(document, F.lit("_"), F.format_string("%04d", number.cast("long")))


def embedding_input(title: Column, text: Column) -> Column:
    return compact(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def lucene_escape(text: Column) -> Column:
    """Query syntax characters become spaces."""
    return compact(F.regexp_replace(text, r'[+\-&|!(){}\[\]^"~*?:\\/]', " "))


def strip_fence(text: Column) -> Column:
    """A reply without the fence of a code block around it."""
    body = F.trim(F.regexp_replace(F.regexp_replace(compact_ends(text), r"(?i)^```(?:[a-z]*)?\s*", ""), r"```\s*$", ""))
    return F.when(compact_ends(text).startswith("```"), compact_ends(body)).otherwise(compact_ends(text))


def compact_ends(text: Column) -> Column:
    """White space trimmed at both ends, kept inside."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}|{SPACES}$", "")


def sentences(text: Column) -> Column:
    """Sentences of a compacted text, none of them empty."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def windows(single: Column, joined, length=F.length, short: int = 220) -> Column:
    """All of an array, then what ``joined`` makes of neighbours whose first is shorter than ``short``."""
    after = F.slice(single, 2, F.greatest(F.size(single) - 1, F.lit(0)))
    pairs = F.zip_with(single, after, lambda a, b: F.when(b.isNotNull() & (length(a) < short), joined(a, b)))
    return F.concat(single, F.filter(pairs, lambda p: p.isNotNull()))


def sentence_windows(text: Column, short: int = 220) -> Column:
    """All sentences, then neighbouring pairs whose first is shorter than ``short``."""
    return let(sentences(compact(text)), lambda single: windows(single, lambda a, b: F.concat_ws(" ", a, b), short=short))


def csv_cell(value: Column) -> Column:
    """White space collapsed, quoted where RFC 4180 asks for it."""
    text = compact(value.cast("string"))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))).otherwise(text)


def score_bar(total: Column, most: int, width: int = 10) -> Column:
    """``total`` of ``most`` as filled and empty blocks."""
    filled = F.floor(total / most * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))


def context_block(rank: Column, document: Column, chunk: Column, title: Column, score: Column, terms: Column, text: Column) -> Column:
    """One retrieved chunk as text for an answer."""
    lines = {"document_id": document, "chunk_id": chunk, "title": F.coalesce(title, F.lit("")), "retrieval_score": F.format_string("%.6f", F.coalesce(score, F.lit(0.0))), "matched_terms": F.array_join(terms, ", "), "text": text}
    return F.concat_ws("\n", F.format_string("[Chunk %d]", rank.cast("int")), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()])


def context(rows: DataFrame, order: list) -> DataFrame:
    """``context``: all blocks of retrieved rows (``document_id, chunk_id, title, score, matched_terms, text``), in their order.

    For what a question retrieves, a few rows: they come to one task.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    blocks = ranked.select("_rank", context_block(F.col("_rank"), F.col("document_id"), F.col("chunk_id"), F.col("title"), F.col("score"), F.col("matched_terms"), F.col("text")).alias("block"))
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def point_label(text: Column, length: int = 120) -> Column:
    """A short label of a scatter point."""
    head = F.regexp_replace(F.substring(text, 1, length), "\n", " ")
    return F.when(F.length(text) > length, F.concat(head, F.lit("…"))).otherwise(head)


def plain_row(columns: list[str]) -> Column:
    """``name=JSON`` of every column, joined by two spaces; an object's JSON is that of its fields."""
    def json(c: str) -> Column:
        return F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', "$1")

    return F.concat_ws("  ", *[F.concat(F.lit(f"{c}="), json(c)) for c in columns])
