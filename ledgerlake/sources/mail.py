"""Landed bank mail: day/sender/keyword selection and the MIME body pick.

Landed layout: mail_raw(mail_id, sender, received_at timestamp, payload string JSON MIME tree),
ideally partitioned by received date so the day window prunes whole directories.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.text import urlsafe_b64_text, with_fields_once

# The bank-alert search = sender contains this text, and the body has any of
# these words (case-insensitive): debit, spent, transaction, "Rs.", INR.
BANK_SENDER = "bank"
ALERT_WORDS_RE = r"(?i)\b(debit|spent|transaction|inr)\b|rs\."
LIST_CAP_OLD = 500  # the undated variant returns at most this many mails


def bank_mails_on(mails: DataFrame, day: dt.date | None = None, ts_col: str = "received_at",
                  sender_col: str = "sender", sender_text: str = BANK_SENDER) -> DataFrame:
    """Sender and [day, day+1) part of the search: plain column predicates that reach the scan."""
    p = F.lower(F.col(sender_col)).contains(sender_text)
    if day is not None:
        ts_type = dict(mails.dtypes)[ts_col]
        lo = F.lit(dt.datetime.combine(day, dt.time())).cast(ts_type)
        hi = F.lit(dt.datetime.combine(day + dt.timedelta(days=1), dt.time())).cast(ts_type)
        p = p & (F.col(ts_col) >= lo) & (F.col(ts_col) < hi)
    return mails.filter(p)


def has_alert_words(text: Column) -> Column:
    return text.rlike(ALERT_WORDS_RE)


def alert_mails(mails: DataFrame, day: dt.date | None = None, ts_col: str = "received_at",
                sender_col: str = "sender", body_col: str = "body", sender_text: str = BANK_SENDER) -> DataFrame:
    """Mails of one day [day, day+1) from the bank that look like transaction alerts.

    The day bounds are literals of the column's own type, so the range is pushed to the
    scan (and prunes date partitions when the table is partitioned by day).
    """
    p = F.lower(F.col(sender_col)).contains(sender_text) & F.col(body_col).rlike(ALERT_WORDS_RE)
    if day is not None:
        ts_type = dict(mails.dtypes)[ts_col]
        lo = F.lit(dt.datetime.combine(day, dt.time())).cast(ts_type)
        hi = F.lit(dt.datetime.combine(day + dt.timedelta(days=1), dt.time())).cast(ts_type)
        p = p & (F.col(ts_col) >= lo) & (F.col(ts_col) < hi)
    return mails.filter(p)


def todays_alert_mails(mails: DataFrame, **kw) -> DataFrame:
    return alert_mails(mails, dt.datetime.now(dt.timezone.utc).date(), **kw)


def latest_alert_mails(mails: DataFrame, n: int = LIST_CAP_OLD, **kw) -> DataFrame:
    """Undated variant: newest n alert mails (a top-n, planned as TakeOrderedAndProject)."""
    ts_col = kw.get("ts_col", "received_at")
    return alert_mails(mails, None, **kw).orderBy(F.col(ts_col).desc(), F.col("mail_id")).limit(n)


# ---------------------------------------------------------------- MIME body
_MAX = 2147483647
UNROLL_DEPTH = 4


def _mime(v: Column) -> Column:
    return F.try_variant_get(v, "$.mimeType", "string")


def _data(v: Column) -> Column:
    return F.try_variant_get(v, "$.body.data", "string")


def _parts(v: Column) -> Column:
    return F.try_variant_get(v, "$.parts", "array<variant>")


def _cand(path: Column, data: Column) -> Column:
    return F.array(F.struct(path.alias("k"), data.alias("d")))


_EMPTY = "array<struct<k:array<int>,d:string>>"


def _candidates(node: Column, path: Column, depth: int) -> Column:
    """Every body the depth-first search could return, keyed by its visiting order.

    A text/html part with data is keyed by its path; a container (root or a part with
    parts) with its own data is keyed by path + [MAX], i.e. after all its children.
    The smallest key is the body the search returns.
    """
    empty = F.array().cast(_EMPTY)

    def child(p: Column, i: Column) -> Column:
        cpath = F.concat(path, F.array(i.cast("int")))
        own_html = F.when((_mime(p) == "text/html") & (F.coalesce(F.length(_data(p)), F.lit(0)) > 0),
                          _cand(cpath, _data(p))).otherwise(empty)
        if depth <= 1:
            return own_html
        nested = F.when(_parts(p).isNotNull(), _candidates(p, cpath, depth - 1)).otherwise(empty)
        return F.concat(own_html, nested)

    kids = F.flatten(F.transform(F.coalesce(_parts(node), F.array().cast("array<variant>")), child))
    own = F.when(F.coalesce(F.length(_data(node)), F.lit(0)) > 0,
                 _cand(F.concat(path, F.array(F.lit(_MAX))), _data(node))).otherwise(empty)
    return F.concat(kids, own)


def _deeper_than(node: Column, depth: int) -> Column:
    """True when some part at `depth` still has parts (the unrolled search cannot see it)."""
    if depth == 0:
        return _parts(node).isNotNull()
    return F.exists(F.coalesce(_parts(node), F.array().cast("array<variant>")), lambda p: _deeper_than(p, depth - 1))


def _first_body(root: Column, levels: Column) -> Column:
    """The smallest of _candidates' entries at any depth: one step per level of the tree, `levels` at
    least as many as it has (steps below its last level see no nodes)."""
    none = F.lit(None).cast("struct<k:array<int>,d:string>")
    has_data = lambda v: F.coalesce(F.length(_data(v)), F.lit(0)) > 0

    def step(acc: Column, _: Column) -> Column:
        below = F.flatten(F.transform(acc["nodes"], lambda n: F.transform(
            _parts(n["v"]), lambda p, i: F.struct(F.concat(n["k"], F.array(i.cast("int"))).alias("k"), p.alias("v")))))

        def seen(kids: Column) -> Column:
            html = F.transform(F.filter(kids, lambda n: (_mime(n["v"]) == "text/html") & has_data(n["v"])),
                               lambda n: F.struct(n["k"].alias("k"), _data(n["v"]).alias("d")))
            inner = F.filter(kids, lambda n: _parts(n["v"]).isNotNull())
            own = F.transform(F.filter(inner, lambda n: has_data(n["v"])),
                              lambda n: F.struct(F.concat(n["k"], F.array(F.lit(_MAX))).alias("k"), _data(n["v"]).alias("d")))
            return F.struct(inner.alias("nodes"), F.array_min(F.concat(F.array(acc["best"]), html, own)).alias("best"))

        return F.get(F.transform(F.array(below), seen), F.lit(0))  # bound once, used several times

    top = F.array(F.struct(F.array().cast("array<int>").alias("k"), root.alias("v")))
    best = F.when(has_data(root), F.struct(F.array(F.lit(_MAX)).alias("k"), _data(root).alias("d"))).otherwise(none)
    start = F.struct(F.filter(top, lambda n: _parts(n["v"]).isNotNull()).alias("nodes"), best.alias("best"))
    return F.aggregate(F.sequence(F.lit(1), levels), start, step)["best"]


def mime_body(mails: DataFrame, payload_col: str = "payload", depth: int = UNROLL_DEPTH) -> DataFrame:
    """Adds `body`: the first text/html part in depth-first order, else the nearest container's
    own body, decoded from URL-safe base64; '' when there is none.

    Trees up to `depth` levels are resolved by an unrolled expression, the rare deeper ones by a
    loop over their levels with the same ordering rule; either is per row, so mails are read once.
    """
    v = F.try_parse_json(F.col(payload_col))  # null for a payload that is no JSON: no body
    keyed = with_fields_once(mails, {"__v": v})
    # every level of a tree opens a list
    levels = F.greatest(F.length(payload_col) - F.length(F.replace(F.col(payload_col), F.lit("["))), F.lit(1))
    deep = F.coalesce(_deeper_than(F.col("__v"), depth), F.lit(False))
    pick = F.when(deep, _first_body(F.col("__v"), levels)).otherwise(
        F.array_min(_candidates(F.col("__v"), F.array().cast("array<int>"), depth)))
    return keyed.withColumn("body", F.coalesce(urlsafe_b64_text(pick["d"]), F.lit(""))).drop("__v")


def mail_text(mails: DataFrame, html_col: str = "body") -> DataFrame:
    """HTML body -> stripped non-empty text lines joined by newline (as `text`), built once per mail
    however often later steps read it."""
    from ledgerlake.functions.text import html_text_lines

    return with_fields_once(mails, {"text": html_text_lines(F.col(html_col))})
