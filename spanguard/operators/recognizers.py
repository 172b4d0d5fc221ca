"""Recognizers: a pattern, tests on what it matched, and a score.

No pattern reads a character more often than a fixed number of times, whatever the text: a run of characters
is entered only at its beginning (or where the match before ended) and never given back, and nothing
repeats a group in a way that needs the stack. What may not stand next to a match is a separate test on the
neighbouring characters. A pattern must not match the empty text. Only the private key crosses line breaks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from spanguard.functions import checks


#: A text with this mark may hold a private key, which is found whole.
KEY_MARK = "PRIVATE KEY-----"


def _assigns(text: Column) -> Column:
    return F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))


#: Cheap tests that decide whether a pattern can match at all. Most texts fail most of them, and a
#: failed test costs one scan of the bytes where a pattern costs a regular-expression run.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "at": lambda t: F.contains(t, F.lit("@")),
    "scheme": lambda t: F.contains(t, F.lit("://")),
    "assignment": _assigns,
    "colons": lambda t: F.contains(t, F.lit(":")) & t.rlike(":[0-9A-Fa-f]{0,4}:"),
    "jwt": lambda t: F.contains(t, F.lit("eyJ")),
    "pem": lambda t: F.contains(t, F.lit(KEY_MARK)),
}
#: Features by the longest run of digits in a text; each implies the ones before it.
DIGIT_RUNS = {"digit": "[0-9]", "digit4": "[0-9]{4}", "digit7": "[0-9]{7}"}


def digit_level(text: Column) -> Column:
    """How many of the digit features a text has; a longer run is looked for only after a shorter one."""
    level = F.lit(len(DIGIT_RUNS))
    for depth, pattern in reversed(list(enumerate(DIGIT_RUNS.values()))):
        level = F.when(text.rlike(pattern), level).otherwise(F.lit(depth))
    return level


@dataclass(frozen=True)
class Recognizer:
    name: str
    entity_type: str
    pattern: str
    score: float
    #: name of the feature (see FEATURES) a text must have for the pattern to be tried
    feature: str | None = None
    #: character class that may not stand right before / right after the value
    not_before: str | None = None
    not_after: str | None = None
    check: Callable[[Column], Column] | None = None
    #: lowercase words of which one must occur somewhere in the text, besides the feature
    words: tuple[str, ...] = ()
    #: lowercase words; one of them near the value lifts the score to `cue_score`
    cues: tuple[str, ...] = ()
    cue_score: float = 0.0
    #: a check on the value and the characters before and after it
    edge_check: Callable[[Column, Column, Column], Column] | None = None
    #: pattern with one group that gives the value inside the match, and how many characters of
    #: the match follow that value
    value_pattern: str | None = None
    trailing: Callable[[Column], Column] | None = None
    #: the values inside a match, as ARRAY<STRUCT<at INT, value STRING>>, instead of one
    parts: Callable[[Column], Column] | None = None

    @property
    def best_score(self) -> float:
        return max(self.score, self.cue_score)


def _fresh(characters: str) -> str:
    """Where a run of such characters begins, or the match before ended."""
    return rf"(?:\G|(?<![{characters}]))"


_NAME = r"A-Za-z0-9_\-"
_MAIL = r"A-Za-z0-9._%+\-"
#: Quoted values may hold blanks; bare ones end at white space, quotes, separators and brackets.
_VALUE = r"""(?:"[^"\r\n]++"|'[^'\r\n]++'|[^\s"'`,;(){}\[\]<>=:][^\s"'`,;(){}\[\]<>]*+)"""
_ASSIGNED = r"""^[^:=]*(?::=|=>|=|:)[ \t]*["']?(.*?)["']?$"""
#: Body of a private key up to its footer, or lines of its encoding where there is none.
_KEY = (r"-----BEGIN [A-Z0-9 ]*+(?<=PRIVATE KEY)-----"
        r"(?:[^\-]*+(?:-(?!----)[^\-]*+)*+-----END [A-Z0-9 ]*+(?<=PRIVATE KEY)-----"
        r"|(?:(?:[ \t\r\n]|\\[nr])*+[A-Za-z0-9+/]{20,}+={0,2}+)*+)")


def _assignment(name: str, entity: str, cue: str, words: tuple[str, ...], score: float) -> Recognizer:
    pattern = rf"""(?i){_fresh(_NAME)}(?>[{_NAME}]*?(?:{cue}))[{_NAME}]*+["']?[ \t]*+(?::=|=>|=|:)[ \t]*+{_VALUE}"""
    return Recognizer(name, entity, pattern, score, feature="assignment", words=words, value_pattern=_ASSIGNED,
                      trailing=lambda match: F.when(match.rlike("[\"']$"), 1).otherwise(0), edge_check=checks.secret_ok)


SHIPPED: tuple[Recognizer, ...] = (
    Recognizer("email", "EMAIL_ADDRESS",
               rf"{_fresh(_MAIL)}[{_MAIL}]++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}", 1.0, feature="at"),
    Recognizer("credit_card", "CREDIT_CARD",
               r"(?<![0-9])(?=[0-9 \-]{13})[0-9]++(?:[ \-][0-9]++)*+", 1.0, feature="digit4", parts=checks.cards_in),
    Recognizer("ipv4", "IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.95,
               feature="digit", not_before="[0-9.]", not_after="[0-9]", check=checks.octets_ok),
    # At most as many characters as an address has, up to no lone colon; what goes on behind it is none.
    Recognizer("ipv6", "IP_ADDRESS",
               r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,39}(?<!(?<!:):)(?:(?:\.[0-9]{1,3}){3})?"
               r"(?:%[0-9A-Za-z][0-9A-Za-z._\-]{0,30}(?<![._\-]))?(?![0-9A-Za-z]|:[0-9A-Za-z:]|\.[0-9])", 0.95,
               feature="colons", check=checks.ipv6_ok),
    Recognizer("phone", "PHONE_NUMBER",
               r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?[ .\-]?[0-9]{2,4}[ .\-]?[0-9]{2,4}(?:[.\-]?[0-9]{2,4})?"
               r"|\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}",
               0.75, feature="digit", not_before="[0-9A-Za-z+.]", not_after="[0-9]", check=checks.phone_ok),
    _assignment("api_key", "API_KEY", r"api[_\-]?key|access[_\-]?key|token|bearer", ("apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "token", "bearer"), 0.8),
    _assignment("password", "PASSWORD", r"password|passwd|pwd", ("password", "passwd", "pwd"), 0.8),
    _assignment("secret", "SECRET", r"secret|credential", ("secret", "credential"), 0.8),
    Recognizer("iban", "IBAN_CODE",
               r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 1.0,
               feature="digit", not_before="[A-Za-z0-9]", not_after="[A-Za-z0-9]", check=checks.iban_ok),
    Recognizer("url", "URL",
               r"(?:https?|ftp)://[^ \t\r\n\"'<>`()\[\]{}|\\^]*[^ \t\r\n\"'<>`()\[\]{}|\\^.,;:!?]", 0.6,
               feature="scheme"),
    Recognizer("ssn", "US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85, feature="digit4",
               not_before=r"[0-9A-Za-z\-]", not_after=r"[0-9A-Za-z]", check=checks.ssn_ok),
    Recognizer("itin", "US_ITIN", r"9[0-9]{2}-[0-9]{2}-[0-9]{4}", 0.85, feature="digit4",
               not_before=r"[0-9A-Za-z\-]", not_after=r"[0-9A-Za-z]", check=checks.itin_ok),
    Recognizer("nhs", "UK_NHS", r"[0-9]{3}[ \-]?[0-9]{3}[ \-]?[0-9]{4}", 0.4,
               feature="digit4", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", check=checks.nhs_ok,
               cues=("nhs", "health", "patient"), cue_score=0.85),
    Recognizer("dea", "MEDICAL_LICENSE", r"[A-Za-z][A-Za-z9][0-9]{7}", 0.6,
               feature="digit7", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", check=checks.dea_ok),
    Recognizer("aadhaar", "IN_AADHAAR", r"[2-9][0-9]{3}[ \-]?[0-9]{4}[ \-]?[0-9]{4}", 0.6,
               feature="digit4", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", check=checks.verhoeff_ok),
    Recognizer("pan", "IN_PAN", r"[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]", 0.7,
               feature="digit4", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]"),
    Recognizer("us_passport", "US_PASSPORT", r"[A-Z][0-9]{8}|[0-9]{9}", 0.1,
               feature="digit7", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", cues=("passport",), cue_score=0.7),
    Recognizer("in_passport", "IN_PASSPORT", r"[A-Z][1-9][0-9]{5}[1-9]", 0.1,
               feature="digit7", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", cues=("passport",), cue_score=0.7),
    Recognizer("us_bank", "US_BANK_NUMBER", r"[0-9]{8,17}", 0.1,
               feature="digit7", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", cues=("account", "bank", "routing"),
               cue_score=0.6),
    Recognizer("us_driver", "US_DRIVER_LICENSE", r"[A-Z][0-9]{7,12}", 0.1,
               feature="digit7", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", cues=("driver", "licen"),
               cue_score=0.65),
    Recognizer("crypto", "CRYPTO",
               r"[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71}", 1.0,
               feature="digit", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]", check=checks.crypto_ok),
    Recognizer("date", "DATE_TIME",
               r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
               0.6, feature="digit4", not_before="[0-9A-Za-z]", not_after="[0-9A-Za-z]",
               check=checks.calendar_ok),
    Recognizer("jwt", "JWT",
               rf"{_fresh(_NAME)}(?>[{_NAME}]*?eyJ)[{_NAME}]{{5,}}+\.[{_NAME}]{{5,}}+\.[{_NAME}]{{5,}}", 0.95,
               feature="jwt", value_pattern="(eyJ.*)$"),
    Recognizer("private_key", "PRIVATE_KEY", _KEY, 1.0, feature="pem"),
)
BY_NAME = {r.name: r for r in SHIPPED}
_custom: dict[str, Recognizer] = {}


def register_recognizer(recognizer: Recognizer) -> None:
    """Add a recognizer of the caller's own, or replace a shipped one of the same name."""
    _custom[recognizer.name] = recognizer


def unregister_recognizer(name: str) -> None:
    _custom.pop(name, None)


def active(names: tuple[str, ...] | None = None, min_confidence: float = 0.0) -> list[Recognizer]:
    """The chosen recognizers that can reach the wanted score at all."""
    known = {**BY_NAME, **_custom}
    chosen = list(known.values()) if names is None else [known[n] for n in names]
    return [r for r in chosen if r.best_score >= min_confidence]
