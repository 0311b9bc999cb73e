"""Staff names: cleaning, variants, roles, and dictionary redaction."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules as R
from ..functions import text as T
from ..rows import explode_rows
from ..rules import Rule
from ..session import MAX_RULE_ROWS, bounded_rows, broadcast_if_small
from . import token_pairs

SEPARATOR = r"(?:\s|,|\.|\-|_)+"
MIN_VARIANT_CHARS = 7
#: Letters whose case patterns must name: without (?u), (?i) folds A-Z alone.
ACCENTED, ACCENTED_CAPITALS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŸ"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ACCENTED_CAPITALS
SMALL = "abcdefghijklmnopqrstuvwxyz" + ACCENTED
#: Tokens of the join: runs of a-z, and accented letters one by one, because a name
#: may stand right after or before an accented letter.
NAME_TOKEN = r"[a-z]+|[ß-öø-ÿ]"
#: 8-byte hashes up to this many are broadcast to thin the pairs of documents.
MAX_PAIR_HASHES = 2_000_000

# What is stripped from a staff name, in this order.
NAME_NOISE = [
    r"(?i)\b(?:prof\.?|kom\.?\s*pol\.?)\b",
    r"(?i)\bdrg?\.?\s*",
    r"(?i)\bSp\.?\s*[A-Za-z]+(?:[\.\-\s]?[A-Za-z]+)*(?:\([Kk]\))?",
    r"(?i)\bSubsp\.?\s*[A-Za-z\.\-\(\)]+",
    r"(?i)\b(?:M\.?Kes|MH\.?Kes|M\.?Sc|MM|MMRS|PhD|FINASIM|FIHA|KIC|FICS|SH|MH|CAHM|KHOM|CH)\b\.?,?",
    r"(?i)\b(?:H\.?|Hj\.?|Haji|Hajah)\b\.?,?",
    r"[^A-Za-zÀ-ÖØ-öø-ÿ'` -]",
]


def role_of(value: Column | str) -> Column:
    """Role from the degree in a name: the longest specialist code contained in
    the compacted text, else any specialist, dentist, physician, or DOKTER."""
    codes = sorted(R.SPECIALIST_ROLES, key=len, reverse=True)
    needles = [re.sub(r"[.\s\-]+", "", c) for c in codes]
    by_needle = F.expr("map(%s)" % ", ".join(f"'{n}', '{R.SPECIALIST_ROLES[c]}'" for n, c in zip(needles, codes)))
    ordered = F.expr("array(%s)" % ", ".join(f"'{n}'" for n in needles))
    low = F.lower(T.col(value))
    # A one-element array gives the compacted text a name inside the expression.
    compact = F.array(F.regexp_replace(low, r"[\s,.\-]+", ""))
    found = F.filter(ordered, lambda n: F.exists(compact, lambda c: c.contains(n)))
    return F.when(
        low.contains("sp") | low.rlike(r"s[\s,.\-]+p"),
        F.coalesce(
            F.try_element_at(by_needle, F.try_element_at(found, F.lit(1))),
            F.when(low.rlike(r"\bsp\.?\s*[a-z]"), F.lit("DOKTER_SPESIALIS")),
            _plain_role(low),
        ),
    ).otherwise(_plain_role(low))


def _plain_role(low: Column) -> Column:
    return (
        F.when(low.rlike(r"\bdrg\.?\b"), F.lit("DOKTER_GIGI"))
        .when(low.rlike(r"\bdr\.?\b|\bdr\s*,"), F.lit("DOKTER_UMUM"))
        .otherwise(F.lit("DOKTER"))
    )


def clean_staff_name(name: Column | str) -> Column:
    stripped = reduce(lambda x, p: F.regexp_replace(x, p, " "), NAME_NOISE, F.trim(T.col(name)))
    return T.collapse_space(stripped)


def name_tokens(name: Column | str) -> Column:
    return F.filter(
        F.split(clean_staff_name(name), " "),
        lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*R.TITLE_WORDS),
    )


def name_variants(tokens: Column) -> Column:
    """Sub-sequences of a name worth searching: at least two words and seven
    characters, no clinical word."""
    n = F.size(tokens)
    first, last = F.element_at(tokens, 1), F.try_element_at(tokens, F.lit(-1))

    def when(cond, *parts):
        return F.when(cond, F.array_join(F.array(*parts) if len(parts) > 1 else parts[0], " "))

    second = F.try_element_at(tokens, F.lit(2))
    variants = F.array(
        when(n >= 2, tokens),
        when(n >= 2, F.slice(tokens, 1, 2)),
        when(n >= 2, F.try_element_at(tokens, F.lit(1)), last),
        when(n >= 3, F.try_element_at(tokens, F.lit(1)), second, last),
        when(n >= 3, F.slice(tokens, -2, 2)),
        when(n >= 4, F.slice(tokens, 1, 3)),
        when(n >= 4, F.slice(tokens, -3, 3)),
    )
    return F.filter(
        F.array_distinct(variants),
        lambda v: v.isNotNull()
        & (F.length(v) >= MIN_VARIANT_CHARS)
        & ~F.exists(F.split(F.lower(v), " "), lambda w: w.isin(*R.CLINICAL_STOPWORDS)),
    )


def staff_variants(staff: DataFrame) -> DataFrame:
    """``(name, role)`` -> distinct ``(variant, role)``; an empty role is
    inferred from the name."""
    named = staff.select(
        F.trim("name").alias("name"),
        F.coalesce(F.nullif(F.trim("role"), F.lit("")), role_of(F.trim("name"))).alias("role"),
    )
    exploded = explode_rows(named, ["role"], name_variants(name_tokens("name")), "variant")
    return exploded.groupBy(F.lower("variant").alias("key"), "role").agg(F.min("variant").alias("variant")).select("variant", "role")


def order_longest_first(variants: DataFrame) -> DataFrame:
    return variants.orderBy(F.length("variant").desc(), "variant", "role")


def variant_pattern(variant: str) -> str:
    return SEPARATOR.join(T.quote_regex(p) for p in variant.split())


def letter_pattern(ch: str) -> str:
    if ch in ACCENTED:
        return f"[{ch}{ACCENTED_CAPITALS[ACCENTED.index(ch)]}]"
    return SEPARATOR if ch == " " else T.quote_regex(ch)


def alternation(variants: list[str]) -> str:
    """One pattern for many names, factored by common prefixes: at a position
    the cost follows the letters of the text, not the number of names.  Longer
    names come first, as in a longest-first alternation."""
    tree: dict = {}
    for v in variants:
        node = tree
        for ch in " ".join(v.translate(str.maketrans(CAPITALS, SMALL)).split()):
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = [letter_pattern(ch) + pattern(node[ch]) for ch in sorted(node) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in node else body

    return r"(?<![A-Za-z])" + pattern(tree) + r"(?![A-Za-z])"


def role_rules(rows: list[tuple[str, str]]) -> list[Rule]:
    """One alternation per role, roles by their longest variant (ties: by name), so
    that a name is not cut by a shorter one of another role.  Needles are the
    shortest first words, so a text without any of a role's first names skips its
    alternation."""
    by_role: dict[str, list[str]] = {}
    for variant, role in rows:
        by_role.setdefault(role, []).append(variant)
    out = []
    for role in sorted(by_role, key=lambda r: (-max(map(len, by_role[r])), r)):
        firsts = sorted({v.split()[0].lower() for v in by_role[role]})
        needles = tuple(firsts) if len(firsts) <= 12 else ()
        out.append(Rule(f"staff_csv_{role}", alternation(by_role[role]), f"[{role}]", "i", needles))
    return out


def compile_staff(variants: DataFrame, max_rows: int = MAX_RULE_ROWS) -> list[Rule] | None:
    """Rules of a dictionary of bounded size, or None: then only
    :func:`redact_staff_join` can hold it.  ``redact`` takes the variants
    themselves and chooses; it does not take None."""
    rows = bounded_rows(variants.select("variant", "role"), max_rows)
    return None if rows is None else role_rules([(r["variant"], r["role"]) for r in rows])


def folded(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def name_words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(NAME_TOKEN), F.lit(0))


def _letter_pattern(ch: Column) -> Column:
    """:func:`letter_pattern` of a one-letter column."""
    return (
        F.when(ch == " ", F.lit(SEPARATOR))
        .when(ch.isin(*ACCENTED), F.concat(F.lit("["), ch, F.translate(ch, ACCENTED, ACCENTED_CAPITALS), F.lit("]")))
        .otherwise(F.regexp_replace(ch, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"))
    )


def name_index(variants: DataFrame) -> DataFrame:
    """``(role, name, pair, chars)``: the variants by the pair of tokens they begin with."""
    spelt = variants.select("role", F.length("variant").alias("chars"), F.regexp_replace(F.trim(folded(F.col("variant"))), r"(?U)\s+", " ").alias("name"))
    return spelt.select("role", "name", F.concat_ws(" ", F.slice(name_words(F.col("name")), 1, 2)).alias("pair"), "chars")


def pair_hashes(index: DataFrame, max_hashes: int = MAX_PAIR_HASHES):
    """The hashes of the pairs that names begin with, 8 bytes each, or None
    when there are more than ``max_hashes``."""

    found = index.select(F.arrow_udf(lambda pairs: token_pairs.pair_hash(pairs), "long")("pair").alias("h")).distinct().limit(max_hashes + 1).toArrow()["h"]
    return None if len(found) > max_hashes else found.to_numpy()


def may_hold_name(text: Column, hashes) -> Column:
    """Whether a pair of the text's tokens has the hash of one that a name begins with:
    true wherever a name stands, and where hashes are equal by chance."""
    return F.arrow_udf(lambda texts: token_pairs.holds_pair(texts, hashes), "boolean")(text)


def known_pairs(docs: DataFrame, index: DataFrame, hashes, key: str, text: str = "text") -> DataFrame:
    """``(key, pair)``: the documents' distinct pairs of tokens, as far as a name may
    begin with one of them.  Few documents hold any; without ``hashes`` pairs of all
    documents meet the index."""
    few = docs if hashes is None else docs.filter(may_hold_name(F.col(text), hashes))
    words = few.select(key, name_words(F.col(text)).alias("__w"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("__w") - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.try_element_at("__w", i), F.try_element_at("__w", i + 1)),
    )
    pairs_of = explode_rows(words, [key], F.array_distinct(F.concat(pairs, F.col("__w"), F.array(F.lit("")))), "pair")
    # pairs no name starts with (nearly all) leave before the shuffle
    known = index.select(F.xxhash64("pair").alias("__h")).distinct()
    return pairs_of.withColumn("__h", F.xxhash64("pair")).join(broadcast_if_small(known, MAX_PAIR_HASHES), "__h", "left_semi").drop("__h")


def redact_staff_join(
    docs: DataFrame, variants: DataFrame, key: str, text: str = "text", counts: str = "counts", index: DataFrame | None = None, hashes=None, active: str | None = None
) -> DataFrame:
    """Dictionary redaction for a dictionary of any size.

    Texts and variants are cut into the same tokens (NAME_TOKEN), so wherever the
    compiled pattern finds a variant, whatever mark stands before or after it, the
    variant's tokens are whole tokens of the text, side by side.  Each document's
    distinct pairs of tokens are equi-joined with the variants' leading pair (their
    only token, or "", where a variant has no more); only variants that can occur in
    a document reach it.  Per document and role they become an alternation that tries
    them in the order of the compiled way.  ``index`` and ``hashes`` are the variants'
    name index and its hashes, where they are at hand; ``active`` names a column that
    tells which texts to search."""
    index = name_index(variants) if index is None else index
    longest = index.groupBy("role").agg(F.max("chars").alias("longest"))
    found = (
        known_pairs(docs.filter(active) if active else docs, index, hashes, key, text)
        .join(index.select("role", "name", "pair"), "pair")
        .select(
            key,
            "role",
            # a longer name before its beginning, else by letters: the order of alternation()
            F.concat("name", F.lit("\uffff")).alias("rank"),
            F.array_join(F.transform(F.split("name", ""), _letter_pattern), "").alias("alt"),
        )
        .join(broadcast_if_small(longest), "role")
        .groupBy(key, "role", "longest")
        .agg(F.array_sort(F.collect_set(F.struct("rank", "alt"))).alias("alts"))
        .select(
            key,
            F.struct(
                (-F.col("longest")).alias("rank"),
                "role",
                F.concat(
                    F.lit(r"(?id)(?<![A-Za-z])(?:"),
                    F.array_join(F.col("alts.alt"), "|"),
                    F.lit(r")(?![A-Za-z])"),
                ).alias("pattern"),
            ).alias("rule"),
        )
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("rule")).alias("__rules"))
    )
    walked = F.aggregate(
        F.col("__rules"),
        F.struct(F.col(text).alias("t"), F.array().cast("array<struct<k:string,n:int>>").alias("c")),
        lambda acc, r: F.struct(
            F.regexp_replace(acc["t"], r["pattern"], F.concat(F.lit("["), r["role"], F.lit("]"))).alias("t"),
            F.concat(
                acc["c"],
                F.array(F.struct(F.concat(F.lit("staff_csv_"), r["role"]).alias("k"), F.regexp_count(acc["t"], r["pattern"]).alias("n"))),
            ).alias("c"),
        ),
    )
    out = docs.join(found, key, "left").withColumn("__w", F.when(F.col("__rules").isNotNull(), walked))
    hits = F.map_from_entries(F.filter("__w.c", lambda e: e["n"] > 0))
    base = F.col(counts) if counts in docs.columns else F.create_map().cast("map<string,int>")
    zero = F.lit(0)
    return out.withColumns(
        {
            text: F.coalesce(F.col("__w.t"), F.col(text)),
            counts: F.when(
                F.col("__w").isNotNull(),
                F.map_zip_with(base, hits, lambda _, a, b: F.coalesce(a, zero) + F.coalesce(b, zero)),
            ).otherwise(base),
        }
    ).drop("__w", "__rules")


def redact_staff(docs: DataFrame, variants: DataFrame, key: str, max_rows: int = MAX_RULE_ROWS, **kw) -> DataFrame:
    """Compiled alternations for a small dictionary, the word-pair join beyond."""
    from .redact import apply_rules

    rules = compile_staff(variants, max_rows)
    if rules is None:
        return redact_staff_join(docs, variants, key, **kw)
    return apply_rules(docs, rules, **kw)
