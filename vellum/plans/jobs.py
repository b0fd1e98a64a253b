"""Operations as jobs: started, watched and cancelled by name."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from vellum.sources.docx import read_docx
from vellum.sources.package import Limits

from . import corpus

# The phases that an operation reports.
PHASES = ("inspect", "read", "write")


@dataclass
class Operation:
    """An action in a thread with a job group of its own; `result` waits for it and raises what it raised."""

    spark: SparkSession
    name: str
    action: Callable[[], object]
    _done: dict = field(default_factory=dict)
    _thread: threading.Thread | None = None

    def start(self) -> Operation:
        from pyspark import InheritableThread

        def run() -> None:
            self.spark.sparkContext.setJobGroup(self.name, self.name, interruptOnCancel=True)
            try:
                self._done["value"] = self.action()
            except Exception as e:  # noqa: BLE001  handed to the caller by result()
                self._done["error"] = e

        self._thread = InheritableThread(target=run, session=self.spark)
        self._thread.start()
        return self

    def progress(self) -> tuple[int, int]:
        """(finished, all) tasks of the stages that run for it."""
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.name):
            for stage in tracker.getJobInfo(job).stageIds if tracker.getJobInfo(job) else ():
                if info := tracker.getStageInfo(stage):
                    done, total = done + info.numCompletedTasks, total + info.numTasks
        return done, total

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.name)

    def result(self):
        self._thread.join()
        if "error" in self._done:
            raise self._done["error"]
        return self._done["value"]


# Media types of outputs.
MEDIA = {"html": "text/html;charset=utf-8", "markdown": "text/markdown;charset=utf-8", "epub": "application/epub+zip"}


class Cancelled(Exception):
    pass


class Runtime:
    """Takes requests to analyse, convert and cancel, and sends what becomes of them.

    A request is a mapping with `type` and `operation`, a name. `analyse` reads the packages below `path` and writes their
    relations to `table`; `convert` reads such a table and writes outputs in `format` and `mode` to `output`; both run as an
    Operation. `send` gets mappings: `progress` with a phase of PHASES and counts, then `analysed`, `output` or `error`, which
    has one of the kinds of failure as its code. What a cancelled operation would have sent is an error of code `cancelled`.
    """

    def __init__(self, spark: SparkSession, send: Callable[[dict], None]):
        self.spark, self.send = spark, send
        self._running: dict[str, Operation] = {}
        self._cancelled: set[str] = set()

    def active(self) -> int:
        return len(self._running)

    def handle(self, request: dict) -> None:
        name = request["operation"]
        if request["type"] == "cancel":
            if name in self._running:
                self._cancelled.add(name)
                self._running[name].cancel()
            return
        act = {"analyse": self._analyse, "convert": self._convert}[request["type"]]
        self._running[name] = Operation(self.spark, name, lambda: self._run(act, request))
        self._running[name].start()

    def wait(self, name: str) -> None:
        """Until an operation has sent its last message."""
        if name in self._running:
            self._running[name]._thread.join()

    def _run(self, act: Callable[[dict], dict], request: dict) -> None:
        name = request["operation"]
        try:
            self._go_on(name)
            message = act(request)
            self._go_on(name)
        except Exception as e:  # noqa: BLE001  every failure is a message; none holds text of a document
            cancelled = isinstance(e, Cancelled) or name in self._cancelled
            message = {"type": "error", "code": "cancelled" if cancelled else "conversion-failed", "message": "" if cancelled else type(e).__name__}
        finally:
            self._running.pop(name, None)
            self._cancelled.discard(name)
        self.send(message | {"operation": name})

    def _go_on(self, name: str) -> None:
        if name in self._cancelled:
            raise Cancelled

    def _phase(self, name: str, phase: str, completed: int, total: int) -> None:
        self._go_on(name)
        self.send({"type": "progress", "operation": name, "phase": phase, "completed": completed, "total": total})

    def _analyse(self, request: dict) -> dict:
        name = request["operation"]
        self._phase(name, "inspect", 0, 1)
        packages = read_docx(self.spark, request["path"], request.get("limits", Limits()))
        self._phase(name, "read", 0, 1)
        packages.write.mode("errorifexists").parquet(request["table"])
        kept = self.spark.read.parquet(request["table"])
        counted = kept.selectExpr("count(*)", "count(error)").first()
        return {"type": "analysed", "table": request["table"], "packages": counted[0], "refused": counted[1]}

    def _convert(self, request: dict) -> dict:
        name, format, mode = request["operation"], request["format"], request.get("mode", "single")
        self._phase(name, "write", 0, 1)
        options = {k: request[k] for k in ("formula", "mappings", "preset", "cover", "edits", "authors", "subjects") if k in request}
        made = corpus.convert(self.spark.read.parquet(request["table"]), format, mode, request["date"], **options)
        made.write.mode("errorifexists").parquet(request["output"])
        return {"type": "output", "output": request["output"], "media_type": "application/zip" if mode == "zip" else MEDIA[format]}
