"""Independent steps of a run at the same time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Steps whose jobs share the executors; others wait.
STEPS = 8


@contextmanager
def at_once(spark: SparkSession) -> Iterator[Callable[..., Future]]:
    """Gives ``begin(step, *arguments)``, whose ``result()`` is that of the step.

    Jobs of one step leave cores idle at the end of each stage and while the next is planned; those of other steps use them.
    All steps are over at the end, and the first error among them is raised there, if nobody asked for its result.
    """
    begun: list[Future] = []
    with ThreadPoolExecutor(STEPS) as pool:

        def begin(step: Callable, *arguments) -> Future:
            begun.append(pool.submit(inheritable_thread_target(spark)(step), *arguments))
            return begun[-1]

        yield begin
        for step in begun:
            step.result()
