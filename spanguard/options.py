"""Validated, immutable scan options. Values become literals in the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from spanguard import rules


class OptionsError(ValueError):
    """An option has a value outside its allowed range."""


@dataclass(frozen=True)
class ScanOptions:
    supported_extensions: tuple[str, ...] = rules.SCANNED_EXTENSIONS
    excluded_directories: tuple[str, ...] = rules.EXCLUDED_DIRECTORIES
    max_file_size_bytes: int = 5 * 1024 * 1024
    min_confidence: float = 0.5
    warning_threshold: int = 20
    fail_threshold: int = 50
    redact: bool = True
    #: findings per nested report row; further findings go to further rows
    report_page_size: int = 10_000
    #: recognizer names to run; None means all shipped ones
    recognizers: tuple[str, ...] | None = None
    severity_overrides: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not 0.0 <= self.min_confidence <= 1.0:
            raise OptionsError(f"min_confidence must be in [0, 1], got {self.min_confidence}")
        if self.warning_threshold < 0 or self.fail_threshold < 0:
            raise OptionsError("thresholds must be >= 0")
        if self.fail_threshold < self.warning_threshold:
            raise OptionsError(
                f"fail_threshold {self.fail_threshold} is below warning_threshold {self.warning_threshold}"
            )
        if self.max_file_size_bytes < 0:
            raise OptionsError("max_file_size_bytes must be >= 0")
        if self.report_page_size < 1:
            raise OptionsError("report_page_size must be >= 1")
        unknown = set(self.severity_overrides.values()) - set(rules.SEVERITIES)
        if unknown:
            raise OptionsError(f"unknown severities {sorted(unknown)}")


DEFAULT_OPTIONS = ScanOptions()
