"""Interactive console: statements and commands that begin with a colon, a line each."""

from __future__ import annotations

import shlex
import subprocess
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .engine import Engine
from .metrics import Metrics
from .sources import sinks

HELP = """\
:help                  this list
:quit                  leave
:sleep SECONDS         wait
:tee [-o] FILE         keep a copy of what is shown; -o starts the file anew
:notee                 stop that
:pager COMMAND ROWS    send results of more than ROWS rows through COMMAND
:nopager               stop that
:timeout SECONDS       end statements that take longer; 0 for no limit
:clear                 clear the screen
:flush                 write the catalog's graphs
a statement that ends with \\G is shown a column a line"""
ALIASES = {"h": "help", "q": "quit", "exit": "quit", "e": "quit", "save": "flush"}


class Console:
    """``line`` takes one line and says whether to go on."""

    def __init__(self, engine: Engine, show: Callable[[str], None] = print, metrics: Metrics | None = None, rows: int = sinks.SHOWN):
        self.engine, self.out, self.metrics, self.rows = engine, sinks.Tee(show), metrics or Metrics(), rows
        self.pager: tuple[list[str], int] | None = None
        self.timeout = 0.0

    def run(self, lines: Iterable[str]) -> None:
        for text in lines:
            if not self.line(text):
                break
        self.out.close()

    def line(self, text: str) -> bool:
        text = text.strip()
        if not text or text.startswith("#"):
            return True
        try:
            if text.startswith(":"):
                return self.command(*shlex.split(text[1:]))
            self.statement(text)
        except (ValueError, PySparkException, OSError) as e:
            self.out(f"error: {e}")
        return True

    # -- statements -----------------------------------------------------------
    def statement(self, text: str) -> None:
        upright = text.endswith("\\G")
        text = text.removesuffix("\\G").rstrip("; ")
        with self.metrics.query():
            shown, n = self.limited(lambda: self.rendered(self.engine.gql(text), upright))
        if self.pager is not None and n > self.pager[1]:
            subprocess.run(self.pager[0], input=shown, text=True, check=False)
        else:
            self.out(shown)

    def rendered(self, df: DataFrame, upright: bool) -> tuple[str, int]:
        text = (sinks.vertical_text if upright else sinks.table_text)(df, self.rows)
        return text, text.count("-- row ") if upright else int(text.rsplit("\n", 1)[1].split()[0])

    def limited(self, work: Callable[[], tuple[str, int]]) -> tuple[str, int]:
        """``work`` under the time limit: its Spark jobs are cancelled beyond it."""
        if not self.timeout:
            return work()
        context, group = self.engine.spark.sparkContext, f"console-{uuid.uuid4()}"
        late = threading.Event()

        def end() -> None:
            late.set()
            # Jobs that the statement has not started yet end with it, too.
            context._jsc.sc().cancelJobGroupAndFutureJobs(group)

        context.setJobGroup(group, "console statement", True)
        timer = threading.Timer(self.timeout, end)
        timer.start()
        try:
            return work()
        except Exception as e:
            if late.is_set():
                raise ValueError(f"stopped after {self.timeout:g} seconds") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    # -- commands -------------------------------------------------------------
    def command(self, name: str = "", *args: str) -> bool:
        name = ALIASES.get(name.lower(), name.lower())
        if name == "quit":
            return False
        act = getattr(self, f"_{name}", None) if name in HELP_NAMES else None
        if act is None:
            raise ValueError(f"unknown command :{name}, see :help")
        act(*args)
        return True

    def _help(self, *args: str) -> None:
        self.out(HELP)

    def _sleep(self, *args: str) -> None:
        time.sleep(seconds(args, "sleep"))

    def _tee(self, *args: str) -> None:
        anew, names = args[:1] == ("-o",), args[1:] if args[:1] == ("-o",) else args
        if len(names) != 1:
            raise ValueError("usage: :tee [-o] FILE")
        if anew:
            open(names[0], "w", encoding="utf-8").close()  # noqa: SIM115
        self.out.open(names[0])

    def _notee(self, *args: str) -> None:
        self.out.close()

    def _pager(self, *args: str) -> None:
        if len(args) < 2 or not args[-1].isdecimal():
            raise ValueError("usage: :pager COMMAND ROWS")
        self.pager = list(args[:-1]), int(args[-1])

    def _nopager(self, *args: str) -> None:
        self.pager = None

    def _timeout(self, *args: str) -> None:
        self.timeout = seconds(args, "timeout") if args else 0.0

    def _clear(self, *args: str) -> None:
        self.out.show("\x1b[2J\x1b[1;1H")

    def _flush(self, *args: str) -> None:
        self.engine.catalog.flush()


HELP_NAMES = {line[1:].split()[0] for line in HELP.splitlines() if line.startswith(":")}


def seconds(args: tuple[str, ...], name: str) -> float:
    try:
        (value,) = map(float, args)
    except ValueError:
        value = -1.0
    if not 0 <= value < float("inf"):
        raise ValueError(f"usage: :{name} SECONDS")
    return value
