"""The driver's side of a job: text that it answers with."""

from __future__ import annotations


class Job:
    """Collects output on the driver; it isn't for rows."""

    EMPTY = "Job finished, but produced no output"

    def __init__(self) -> None:
        self._parts: list[str] = []

    def output(self, text: str) -> None:
        self._parts.append(text)

    def answer(self) -> str:
        return "".join(self._parts) or self.EMPTY
