"""Jobs that run beside their caller, who may wait for them or stop them."""

from __future__ import annotations

import uuid
from concurrent.futures import CancelledError

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..sources import write_final
from ..storage import Scope
from . import JobSpec, job_of, run_job


class JobHandle:
    """A job that start began: wait() for it, or cancel() it. Several may run in one session at a time."""

    def __init__(self, spark: SparkSession, spec: JobSpec, output: str, single: bool):
        self.spark, self.spec, self.output, self.single = spark, spec, output, single
        self.tag = f"quern-{uuid.uuid4().hex}"
        self.error: BaseException | None = None
        self.cancelled = False
        self.thread = InheritableThread(target=self._run, session=spark, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        self.spark.sparkContext.addJobTag(self.tag)  # of all Spark jobs that this thread starts
        try:
            # What the job wrote for itself goes when its result is there, or when it fails or is stopped.
            with Scope(self.spark) as own:
                result = run_job(self.spark, self.spec)
                if self.cancelled:
                    raise CancelledError
                write_final(result, self.output, job_of(self.spec.job).form, self.single)
                own.drop()
        except BaseException as e:
            self.error = e

    def done(self) -> bool:
        return not self.thread.is_alive()

    def wait(self, timeout: float | None = None) -> str:
        """The folder of the result once it is there. A TimeoutError if it is not by then, a CancelledError if the job was
        stopped; a job's own error is raised here."""
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError(f"job {self.spec.job} still runs")
        if self.error is not None:
            raise CancelledError(f"job {self.spec.job} was stopped") if self.cancelled else self.error
        return self.output

    def cancel(self) -> None:
        """Stop the job's Spark jobs, those running and those it would still start, and come back when it has ended. One that
        has its result already keeps it."""
        self.cancelled = True
        while self.thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.thread.join(0.2)


def start(spark: SparkSession, spec: JobSpec, output: str, single: bool = False) -> JobHandle:
    """Begin a job whose result is written to output as text, and come back at once."""
    job_of(spec.job)  # an unknown name is the caller's error
    return JobHandle(spark, spec, output, single)
