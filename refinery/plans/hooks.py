"""Optional helpers from outside: callables that may know more than the rules, and may fail or be slow."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

#: Seconds for all descriptions together, and for an answer; threads that ask.
DESCRIBE_SECONDS, CHAT_SECONDS, THREADS = 15.0, 25.0, 4


@dataclass
class Hooks:
    """Each is optional; where one is missing, fails or takes too long, the engine goes on without.

    ``roles`` proposes the roles of tables, ``template`` the file name pattern of companion files,
    ``describe`` a line about a variable, ``chat`` an answer about a run (from its context).
    """

    roles: Callable[[dict[str, list[str]]], dict[str, str]] | None = None
    template: Callable[[list[str], list[str]], str | None] | None = None
    describe: Callable[[str, dict[str, Any]], str | None] | None = None
    chat: Callable[[str, dict[str, Any]], str | None] | None = None

    def ask(self, name: str, *args: Any, seconds: float = CHAT_SECONDS) -> Any:
        """What a hook answers, or None."""
        found = self.ask_all(name, [args], seconds)
        return found[0]

    def ask_all(self, name: str, many: Iterable[tuple], seconds: float = DESCRIBE_SECONDS) -> list[Any]:
        """Answers to several questions, asked side by side within one budget of time."""
        questions, hook = list(many), getattr(self, name)
        if hook is None:
            return [None] * len(questions)
        pool = ThreadPoolExecutor(THREADS)
        asked = [pool.submit(hook, *args) for args in questions]
        wait(asked, seconds)
        pool.shutdown(wait=False, cancel_futures=True)
        return [f.result() if f.done() and not f.cancelled() and f.exception() is None else None for f in asked]
