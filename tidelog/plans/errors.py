"""Errors by the domain they belong to, with a hint for each."""

from __future__ import annotations


class LogError(Exception):
    """Any refusal of this package. ``domain`` says whose fault it is."""

    domain = "internal"
    hint = "report it"

    def __init__(self, message: str = "", **details):
        super().__init__(message + ("" if not details else " " + ", ".join(f"{k}={v!r}" for k, v in details.items())))
        self.details = details


class SpecError(LogError):
    domain, hint = "specification", "correct the format's declaration"


class UsageError(LogError):
    domain, hint = "caller", "correct the call"


class VersionMismatch(LogError):
    domain, hint = "schema", "migrate the block, or read it by the version it was written with"


class MissingTarget(LogError):
    domain, hint = "caller", "put the key before operations on it, or read with orphans='skip'"


class KeyLimitExceeded(LogError):
    domain, hint = "limits", "raise the key limit or merge fewer shards"


class LimitExceeded(LogError):
    domain, hint = "limits", "raise the limit that the message names"


class CorruptData(LogError):
    domain, hint = "integrity", "restore the file, or recover with a tolerant policy"


class NotCommitted(LogError):
    domain, hint = "visibility", "commit the cell before it is read"


class NotWritten(LogError):
    domain, hint = "visibility", "write the cell before it is committed"


class StaleCursor(LogError):
    domain, hint = "visibility", "open a new snapshot"


class Locked(LogError):
    domain, hint = "concurrency", "wait for the writer, or clear the lock if it is gone"


class PartialWrite(LogError):
    domain, hint = "io", "batches before the failed one are staged; go on after them"


class OutOfDomain(LogError):
    domain, hint = "caller", "use a key of the declared domain"


def classify(error: BaseException) -> tuple[str, str]:
    """(domain, hint) of an error; errors that Spark raises for this package's guards are known by their text."""
    if isinstance(error, LogError):
        return error.domain, error.hint
    text = str(error)
    for kind in LogError.__subclasses__():
        if f"[{kind.__name__}]" in text:
            return kind.domain, kind.hint
    return ("io", "check the path and its permissions") if isinstance(error, OSError) else ("internal", LogError.hint)
