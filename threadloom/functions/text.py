"""Text expressions. All are plain Column functions: no UDF, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules


def strip(c: Column) -> Column:
    """Trim every kind of white space (Spark's `trim` handles blanks only)."""
    return F.regexp_replace(c, rf"^{rules.SPACE}+|{rules.SPACE}+$", "")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when any word occurs in `c` as a substring."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def extract_mention(c: Column, strip_first: bool = True) -> Column:
    """Handle the text opens with, lower-cased; null when it opens otherwise."""
    source = strip(c) if strip_first else c
    return F.lower(F.nullif(F.regexp_extract(source, rf"^@({rules.WORD})", 1), F.lit("")))


def clean_text(c: Column, collapse: bool = True) -> Column:
    """Drop the opening handle, mark links, tidy white space; null gives ''.

    With `collapse=False` the text is not stripped and inner white space stays;
    that variant knows ASCII handles and blanks alone.
    """
    if not collapse:
        t = F.regexp_replace(F.regexp_replace(c, rf"^{rules.ASCII_HANDLE}\s*", ""), r"https?://\S+", rules.URL_MARK)
        return F.coalesce(t, F.lit(""))
    t = F.regexp_replace(strip(c), rf"^{rules.HANDLE}{rules.SPACE}*", "")
    t = F.regexp_replace(t, rules.URL, rules.URL_MARK)
    t = strip(F.regexp_replace(t, rf"{rules.SPACE}+", " "))
    return F.coalesce(t, F.lit(""))


def clean_for_clustering(c: Column) -> Column:
    """Lower case without handles, links and unusual characters."""
    t = F.lower(c)
    for pattern, put in (
        (rf"@{rules.WORD}", ""),
        (rules.URL, ""),
        (r"\[url\]", ""),
        (rf"[^a-z0-9{rules.SPACE[1:-1]}.,!?]", " "),
        (rf"{rules.SPACE}+", " "),
    ):
        t = F.regexp_replace(t, pattern, put)
    return strip(t)


def opening_words(c: Column, n: int = 3) -> Column:
    """First `n` words after the opening handle."""
    body = strip(F.regexp_replace(c, rf"^{rules.HANDLE}{rules.SPACE}*", ""))
    return F.array_join(F.slice(F.split(body, rf"{rules.SPACE}+"), 1, n), " ")


def word_count(c: Column) -> Column:
    body = strip(c)
    return F.when(c.isNull(), None).when(body == "", 0).otherwise(F.size(F.split(body, rf"{rules.SPACE}+"))).cast("bigint")


def char_count(c: Column) -> Column:
    return F.length(c).cast("bigint")


def conversation_id(customer_id: Column, response_id: Column) -> Column:
    """First 12 hex digits of the md5 of both ids."""
    return F.substring(F.md5(F.concat_ws("_", customer_id.cast("string"), response_id.cast("string"))), 1, 12)


def parse_id_list(c: Column) -> Column:
    """Ids of a comma list, in order; pieces that are no number are left out."""
    def one(piece: Column) -> Column:
        return F.coalesce(piece.try_cast("bigint"), piece.try_cast("double").try_cast("bigint"))

    return F.filter(F.transform(F.split(c, ","), one), lambda i: i.isNotNull())


def last_id(c: Column) -> Column:
    return F.try_element_at(parse_id_list(c), F.lit(-1))


def first_id(c: Column) -> Column:
    """First listed id; null when the first piece is no number."""
    piece = F.split(c, ",").getItem(0)
    return F.coalesce(piece.try_cast("bigint"), piece.try_cast("double").try_cast("bigint"))


def parse_created_at(c: Column) -> Column:
    """Timestamp from `Wed Oct 11 06:55:44 +0000 2017`; null when malformed.

    The day name is skipped: Spark's parser does not read it.
    """
    return F.try_to_timestamp(F.substring(c, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def is_dm_redirect(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(rules.DM_REDIRECT)), F.lit(False))


def with_context(context: Column, message: Column, chars: int = 200) -> Column:
    """Message preceded by the tail of the conversation, when there is any."""
    ctx = strip(context)
    return F.when(ctx != "", F.concat(F.right(ctx, F.lit(chars)), F.lit(" "), message)).otherwise(message)


def conversation_length(context: Column) -> Column:
    """Messages in the exchange: the pair plus the context segments."""
    parts = F.size(F.split(context, r" [|] "))
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(2)).otherwise(parts + 2).cast("bigint")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({rules.WORD})"), 1))


def overlap_share(query_words: Column, doc_words: Column) -> Column:
    """Share of the query's distinct words found in the document; 0 without words."""
    n = F.size(query_words)
    return F.when(n > 0, F.size(F.array_intersect(query_words, doc_words)) / n).otherwise(F.lit(0.0))


def usable(customer_message: Column, reply: Column) -> tuple[Column, Column, Column]:
    """The three usability tests of a pair: customer text, reply text, word count."""
    return (
        F.length(strip(customer_message)) > 5,
        F.length(strip(reply)) > 5,
        word_count(customer_message) >= 3,
    )


def request_key(message: Column, intent: Column, n_cases: Column) -> Column:
    parts = [F.coalesce(p.cast("string"), F.lit("")) for p in (message, intent, n_cases)]
    return F.md5(F.concat_ws("|", *parts))
