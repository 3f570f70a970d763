"""Page, body and error classifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.dims import CAPTCHA_PATTERNS, CHALLENGE_PATTERNS


def _hits(html: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.when(F.rlike(html, F.lit(f"(?i){p}")), 1).otherwise(0)
    return total


def page_kind(html: Column) -> Column:
    """``captcha``, ``waf_challenge``, ``block`` or ``real_content``."""
    text = F.trim(F.regexp_replace(html, r"<[^>]+>", ""))
    return (
        F.when((F.length(html) < 500) & F.rlike(html, F.lit("(?i)<iframe")), "waf_challenge")
        .when(_hits(html, CAPTCHA_PATTERNS) >= 2, "captcha")
        .when(_hits(html, CHALLENGE_PATTERNS) >= 1, "waf_challenge")
        .when((F.length(html) < 300) & (F.length(text) < 50), "block")
        .otherwise("real_content")
    )


def vendor_challenge(html: Column) -> Column:
    """Challenge of one vendor; its tracker alone counts only on tiny pages."""
    return F.rlike(html, F.lit(r"(?i)captcha-delivery\.com")) | (
        (F.length(html) < 5000) & F.rlike(html, F.lit("(?i)datadome")))


def looks_binary(body: Column) -> Column:
    """More than 30 % unprintable characters in the first hundred."""
    sample = F.substring(body, 1, 100)
    bad = F.regexp_replace(sample, r"[^\u0000-\u0008\u000b\u000c\u000e-\u001f�]", "")
    return F.when(F.length(sample) > 0, F.length(bad) / F.length(sample) > 0.3).otherwise(False)


def suspiciously_small(body: Column, content_type: Column) -> Column:
    return (F.length(body) < 500) & F.rlike(content_type, F.lit("(?i)text/html"))


def is_transient(message: Column) -> Column:
    """Errors worth another try: some HTTP codes, socket errors, failed fetches."""
    return (
        F.rlike(message, F.lit(r"^HTTP (401|403|408|425|429|500|502|503|504)\b"))
        | F.rlike(message, F.lit(r"\b(ECONNRESET|ETIMEDOUT|ENOTFOUND|EAI_AGAIN|ECONNREFUSED)\b"))
        | F.rlike(message, F.lit(r"(?i)\bfetch failed\b"))
    )
