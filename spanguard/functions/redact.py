"""Masking of values, texts and logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spanguard import rules

VISIBLE_SUFFIX = 4
#: user name that precedes a token in a clone address (fixed value)
TOKEN_USER = "oauth2"


def redact_value(entity: Column, value: Column) -> Column:
    """Keep two characters and the domain of an e-mail, else only the last four characters."""
    n = F.length(value)
    at = F.instr(value, "@")
    local = F.substring_index(value, "@", 1)
    mail = F.concat(F.substring(local, 1, 2), F.lit("***@"), F.substring(value, at + 1, n))
    return (
        F.when((entity == "EMAIL_ADDRESS") & (at > 0), mail)
        .when(n <= VISIBLE_SUFFIX, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.repeat(F.lit("*"), n - VISIBLE_SUFFIX), F.right(value, F.lit(VISIBLE_SUFFIX))))
    )


def matched_value(entity: Column, value: Column, redact: bool) -> Column:
    return redact_value(entity, value) if redact else value


def mask_secret(text: Column, secret: Column) -> Column:
    """Every occurrence of the secret becomes a marker; no secret leaves the text alone."""
    usable = secret.isNotNull() & (secret != "")
    return F.when(usable, F.replace(text, secret, F.lit(rules.REDACTION_MARKER))).otherwise(text)


def sanitize_text(text: Column, secret: Column) -> Column:
    """`mask_secret`, and the user name of a credential block goes with its secret."""
    usable = secret.isNotNull() & (secret != "")
    block = F.concat(F.lit(TOKEN_USER + ":"), secret, F.lit("@"))
    masked = F.replace(mask_secret(text, secret), block, F.lit(rules.REDACTION_MARKER + "@"))
    return F.when(usable, masked).otherwise(text)
