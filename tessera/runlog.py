"""A record of a run: what it says goes to the screen and to a file of its own, which is never one that is there already.

Only what the program says is kept, never rows of a table.
"""

from __future__ import annotations

import os
import time
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

STAMP = "%Y%m%dT%H%M%SZ"  # fixed format of a run's name: its start in UTC


def open_new(folder: str, at: datetime | None = None):
    """A new file named by time and process; if there is one, by a number more."""
    os.makedirs(folder, exist_ok=True)
    stem = f"{(at or datetime.now(timezone.utc)).strftime(STAMP)}-{os.getpid()}"
    number = 0
    while True:
        try:
            return open(os.path.join(folder, f"{stem}{f'-{number}' if number else ''}.log"), "x", encoding="utf-8", buffering=1)
        except FileExistsError:
            number += 1


@contextmanager
def recording(folder: str | None) -> Iterator[Callable[[str], None]]:
    """Gives a function that says a line, here and (with a folder) in the record; a failure is recorded and passes on."""
    out, began = open_new(folder) if folder else None, time.monotonic()

    def say(line: str) -> None:
        print(line, flush=True)
        if out:
            out.write(f"{time.monotonic() - began:9.2f} {line}\n")

    try:
        yield say
        say("done")
    except BaseException as e:
        if out:
            out.write("".join(traceback.format_exception_only(e)))
        raise
    finally:
        if out:
            out.close()
