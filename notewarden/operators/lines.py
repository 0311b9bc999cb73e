"""Line categories, paragraphs, snippets and the bounded patient context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..rows import explode_rows, posexplode_rows
from ..skew import running_total
from .leaks import lines_of

# Noise lines and limits.
LOW_VALUE_LINES = [
    r"^pasien tampak tidur\.?$", r"^keluarga mendampingi\.?$", r"^instruksi dokter dilanjutkan\.?$",
    r"^terapi dilanjutkan\.?$", r"^terapi oral diberikan\.?$", r"^pasien sudah makan\.?$", r"^edukasi diberikan\.?$",
    r"^observasi lanjut\.?$", r"^monitoring lanjut\.?$", r"^acc\.?$", r"^ok\.?$",
]
NOT_DETECTED = "[tidak terdeteksi]"
LINES_PER_BLOCK = 4
SNIPPET_CHARS = 650
CONTEXT_CHARS = 8000
SHORT_KEYWORD = 3


def line_categories(line: Column, keywords: dict[str, list[str]], patterns: dict[str, list[str]] | None = None) -> Column:
    """ARRAY of the categories of one line: any keyword as substring, or any pattern."""
    low = F.lower(line)
    patterns = patterns or {}
    tests = []
    for category in [*keywords, *[c for c in patterns if c not in keywords]]:
        words = [w.lower() for w in keywords.get(category, [])]
        test = T.any_contains(low, words) if words else F.lit(False)
        for p in patterns.get(category, []):
            test = test | line.rlike("(?i)" + p)
        tests.append(F.when(test, F.lit(category)))
    return F.array_compact(F.array(*tests))


def dedup_key(line: Column) -> Column:
    x = F.regexp_replace(F.lower(line), r"\d{1,2}[:.]\d{2}", "[TIME]")
    x = F.regexp_replace(x, r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", "[DATE]")
    return T.collapse_space(x)


def is_low_value(line: Column) -> Column:
    return F.lower(F.trim(line)).rlike("|".join(LOW_VALUE_LINES))


def categorized_lines(
    df: DataFrame, keys: list[str], keywords: dict[str, list[str]], patterns: dict[str, list[str]] | None = None, text: str = "text"
) -> DataFrame:
    """Lines per category: hits plus their +-1 neighbours, without low-value
    lines, first line per (document, category, masked key).

    Neighbours are looked up in the document's array, so the only shuffle is the
    de-duplication, which combines on the map side."""
    lines = F.transform(lines_of(text), lambda x: T.clean_line(x))
    staged = df.select(
        *keys, F.transform(lines, lambda x: F.struct(x.alias("line"), line_categories(x, keywords, patterns).alias("cats"))).alias("__l")
    )
    rows = posexplode_rows(staged, [*keys, "__l"], "__l")
    none = F.array().cast("array<string>")
    around = F.array_distinct(
        F.concat(
            F.coalesce(F.when(F.col("pos") > 0, F.try_element_at("__l", F.col("pos"))["cats"]), none),
            F.col("item.cats"),
            F.coalesce(F.try_element_at("__l", F.col("pos") + 2)["cats"], none),
        )
    )
    line = F.col("item.line")
    kept = rows.filter((line != "") & ~(is_low_value(line) & (F.size("item.cats") == 0)))
    picked = explode_rows(kept, [*keys, (F.col("pos") + 1).alias("line_no"), line.alias("line")], around, "category").withColumn(
        "key", dedup_key(F.col("line"))
    )
    return (
        picked.groupBy(*keys, "category", "key")
        .agg(F.min(F.struct("line_no", "line")).alias("first"))
        .select(*keys, "category", "first.line_no", "first.line")
    )


def category_log(df: DataFrame, keys: list[str], keywords, patterns=None, text: str = "text") -> DataFrame:
    """Per document: lines, selected lines, detected categories and their list."""
    picked = (
        categorized_lines(df, keys, keywords, patterns, text)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("selected_lines"), F.collect_set("category").alias("__c"))
    )
    totals = df.select(*keys, F.size(lines_of(text)).cast("long").alias("total_lines"))
    return totals.join(picked, keys, "left").select(
        *keys,
        "total_lines",
        F.coalesce("selected_lines", F.lit(0)).cast("long").alias("selected_lines"),
        F.coalesce(F.size("__c"), F.lit(0)).cast("long").alias("n_categories"),
        F.coalesce(F.array_join(F.array_sort("__c"), ", "), F.lit("")).alias("categories"),
    )


def render_categories(df: DataFrame, keys: list[str], keywords, patterns=None, text: str = "text") -> DataFrame:
    """One text per document and category, ``[tidak terdeteksi]`` when empty.
    Groups are the lines of one document, so their size is bounded by it."""
    hits = categorized_lines(df, keys, keywords, patterns, text)
    rendered = hits.groupBy(*keys, "category").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                lambda x: F.concat(F.lit("[L"), x["line_no"].cast("string"), F.lit("] "), x["line"]),
            ),
            "\n",
        ).alias("body")
    )
    spine = df.select(*keys, F.explode(F.array(*[F.lit(c) for c in sorted({*keywords, *(patterns or {})})])).alias("category"))
    return spine.join(rendered, [*keys, "category"], "left").select(
        *keys, "category", F.coalesce("body", F.lit(NOT_DETECTED)).alias("body")
    )


def soft_paragraphs(text: Column | str, lines_per_block: int = LINES_PER_BLOCK) -> Column:
    """Blocks of a text: closed after N lines or at a line that ends a sentence.
    The fold only tracks where blocks start; slicing happens afterwards."""
    lines = F.filter(F.transform(lines_of(text), lambda x: T.collapse_space(x)), lambda x: x != "")
    folded = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("blocks"), F.array().cast("array<string>").alias("buf")),
        lambda acc, line: F.when(
            (F.size(acc["buf"]) + 1 >= lines_per_block) | line.rlike(r"[.!?;:]$"),
            F.struct(
                F.concat(acc["blocks"], F.array(F.array_join(F.concat(acc["buf"], F.array(line)), " "))).alias("blocks"),
                F.array().cast("array<string>").alias("buf"),
            ),
        ).otherwise(F.struct(acc["blocks"].alias("blocks"), F.concat(acc["buf"], F.array(line)).alias("buf"))),
        lambda acc: F.when(F.size(acc["buf"]) > 0, F.concat(acc["blocks"], F.array(F.array_join(acc["buf"], " ")))).otherwise(
            acc["blocks"]
        ),
    )
    return folded


def keyword_test(low: Column, keyword: str) -> Column:
    """Keywords of up to three characters need word boundaries."""
    k = keyword.lower()
    return low.rlike(r"\b" + T.quote_regex(k) + r"\b") if len(k) <= SHORT_KEYWORD else low.contains(k)


def keywords_found(text: Column | str, keywords: list[str]) -> Column:
    low = F.lower(T.col(text))
    return F.array_compact(F.array(*[F.when(keyword_test(low, k), F.lit(k)) for k in keywords]))


def snippet_hash(snippet: Column) -> Column:
    return F.md5(T.collapse_space(F.lower(snippet)))


def compact_snippets(
    df: DataFrame, keys: list[str], groups: dict[str, list[str]], text: str = "text", max_chars: int = SNIPPET_CHARS
) -> DataFrame:
    """Hit block with its neighbours per keyword group, capped, first of equal
    snippets per document: ``(keys, group, block_no, matched, snippet, hash)``."""
    blocks = posexplode_rows(df.select(*keys, soft_paragraphs(text).alias("__b")), [*keys, "__b"], "__b", "block")
    entries = [
        F.struct(F.lit(g).alias("group"), F.array_sort(F.array_distinct(keywords_found("block", words))).alias("matched"))
        for g, words in groups.items()
    ]
    joined = F.array_join(F.slice("__b", F.greatest(F.col("pos"), F.lit(1)), F.when(F.col("pos") > 0, 3).otherwise(2)), " ")
    snippet = F.when(F.length(joined) > max_chars, F.concat(F.substring(joined, 1, max_chars), F.lit(T.TRUNCATED))).otherwise(joined)
    found = F.filter(F.array(*entries), lambda e: F.size(e["matched"]) > 0)
    rows = explode_rows(blocks, [*keys, "__b", "pos"], found, "e").select(
        *keys, "e.group", F.col("pos").alias("block_no"), "e.matched", snippet.alias("snippet")
    ).withColumn("hash", snippet_hash(F.col("snippet")))
    return (
        rows.groupBy(*keys, "group", "hash")
        .agg(F.min(F.struct("block_no", "matched", "snippet")).alias("m"))
        .select(*keys, "group", "m.block_no", "m.matched", "m.snippet", "hash")
    )


def top_snippets(snippets: DataFrame, keys: list[str], limits: dict[str, int], default: int = 3) -> DataFrame:
    """First N snippets per document and group."""
    limit = reduce(lambda rest, kv: F.when(F.col("group") == kv[0], F.lit(kv[1])).otherwise(rest), limits.items(), F.lit(default))
    w = Window.partitionBy(*keys, "group").orderBy("block_no")
    return snippets.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def patient_context(
    snippets: DataFrame, patient: str, order: list[str], limits: dict[str, int], default: int = 3
) -> DataFrame:
    """Global keep-first per snippet hash over a patient's documents, then the
    first N per group.  Keep-first is an aggregate (map-side combined); top-N is
    a row_number filter, which Spark limits before the shuffle."""
    first = (
        snippets.groupBy(patient, "hash")
        .agg(F.min(F.struct(*order, "group", "block_no", "matched", "snippet")).alias("m"))
        .select(patient, *[F.col(f"m.{o}").alias(o) for o in order], "m.group", "m.block_no", "m.matched", "m.snippet")
    )
    limit = reduce(lambda rest, kv: F.when(F.col("group") == kv[0], F.lit(kv[1])).otherwise(rest), limits.items(), F.lit(default))
    largest = max([default, *limits.values()])
    w = Window.partitionBy(patient, "group").orderBy(*order, "block_no")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= largest).filter(F.col("rank") <= limit)


def budget_prefix(df: DataFrame, keys: list[str], order: str, text: str, budget: int = CONTEXT_CHARS, separator: int = 1) -> DataFrame:
    """Rows of each key, in order, while their joined length fits the budget; the
    row that crosses it is cut.  Running sums are bucketed, so a hot key spreads."""
    total = running_total(df, keys, order, F.length(text) + separator, "used")
    start = F.col("used") - F.length(text) - separator
    return (
        total.withColumn("start", start)
        .filter(F.col("start") < budget)
        .withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("start")).cast("int")))
        .drop("start")
    )
