"""All checks of a claim in one run: a registry of rules from tables to findings, and a verdict for each check.

A check is a function from Inputs to rules, registered under its key with the tables that it needs; a rule is a function
that gives findings. What several rules read is worked out once and stored: pages with their kinds, and the values on
them; so a run scans the pages of its input once, whichever checks are asked for. Rules run at the same time, so that one
is planned while the tasks of others keep the cores busy. A new check is one registered function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from functools import cached_property, partial
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import own_folder, stored
from . import classification as K
from . import codes as Q
from . import compare as C
from . import completeness as M
from . import duplicates as U
from . import extraction as E
from . import redflags as R
from . import spelling as L

#: Rules that run at the same time: enough that cores aren't idle while plans are made.
AT_ONCE = 6

Rule = Callable[[], DataFrame]


class shared(cached_property):  # noqa: N801  (used as a decorator)
    """A cached property that several threads may ask for; the first works it out and the others wait."""

    def __get__(self, instance: object, owner: type | None = None):  # noqa: ANN204
        if instance is None:
            return self
        with instance.__dict__.setdefault(f"_lock_of_{self.attrname}", RLock()):
            return super().__get__(instance, owner)


@dataclass
class Inputs:
    """claims (claim, scope, status, vin, customer) and pages (claim, document, page, text); what else is there decides which checks can run."""

    claims: DataFrame
    pages: DataFrame
    invoice_day: str | None = None
    #: SPELL: words (word) and terms (term, place).
    dictionary: DataFrame | None = None
    terms: DataFrame | None = None
    #: META: documents (claim, document, size, text, timed_out, pages_cut, pages_unread, signals).
    documents: DataFrame | None = None
    #: FULL: types that claims have (claim, name), the required ones (name), and unread pages (claim, document, cut, late).
    present: DataFrame | None = None
    required: DataFrame | None = None
    unread: DataFrame | None = None
    #: QR: decoded codes (claim, document, page, value) and searched documents (claim, document, pages_cut, retries_spent, expects).
    codes: DataFrame | None = None
    scans: DataFrame | None = None

    @shared
    def classified(self) -> DataFrame:
        return stored(K.classified(self.pages))

    @shared
    def read(self) -> DataFrame:
        """The fields and numbers of every page, for COMPARE and DUP: patterns go over a page once."""
        return stored(E.read(E.dealt(self.classified)))

    @shared
    def values(self) -> DataFrame:
        return stored(U.page_values(self.read))

    def has(self, names: Sequence[str]) -> bool:
        return all(getattr(self, n) is not None for n in names)


@dataclass(frozen=True)
class Check:
    key: str
    needs: tuple[str, ...]
    run: Callable[[Inputs], list[Rule]]


CHECKS: dict[str, Check] = {}
FINDING = {"claim": "long", "document": "long", "page": "int", "code": "string", "severity": "string", "value": "string"}


def check(key: str, *needs: str) -> Callable:
    """Registers a function from Inputs to lists of rules; needs: tables beyond claims and pages."""
    unknown = set(needs) - {f.name for f in fields(Inputs)}
    if unknown:
        raise ValueError(f"no such input: {', '.join(sorted(unknown))}")

    def add(f: Callable[[Inputs], list[Rule]]) -> Callable:
        CHECKS[key] = Check(key, needs, f)
        return f

    return add


@check("META", "documents")
def _meta(x: Inputs) -> list[Rule]:
    return [lambda: M.extraction_findings(x.documents)]


@check("SPELL", "dictionary", "terms")
def _spell(x: Inputs) -> list[Rule]:
    return [lambda: L.findings(x.classified.select("claim", "document", "page", "text"), x.dictionary, x.terms)]


@check("INTRA")
def _intra(x: Inputs) -> list[Rule]:
    return [lambda: M.claim_id_findings(x.classified.select("claim", "document", "text"), x.claims.select("claim", "vin"))]


@check("QR", "codes", "scans")
def _qr(x: Inputs) -> list[Rule]:
    return [lambda: Q.findings(x.codes, x.classified, x.claims.select("claim", "vin"), x.scans)]


@check("REDFLAG")
def _redflag(x: Inputs) -> list[Rule]:
    def page_flags() -> DataFrame:
        return R.page_flags(x.classified, None if x.invoice_day is None else F.lit(x.invoice_day))

    by_pages = [R.date_flags, R.number_flags, R.checksum_flags, R.mismatch_flags, R.signature_flags]
    return [page_flags, *[partial(lambda f: f(x.classified), f) for f in by_pages], lambda: R.customer_flags(x.classified, x.claims.select("claim", "customer"))]


@check("FULL", "present", "required", "unread")
def _full(x: Inputs) -> list[Rule]:
    return [lambda: M.completeness_findings(x.claims, x.present, x.required, x.unread)]


@check("COMPARE")
def _compare(x: Inputs) -> list[Rule]:
    def claims() -> DataFrame:
        return x.claims.select("claim", "vin", "customer")

    by_claims = [C.car_findings, C.invoice_owner_findings, C.relative_findings, C.old_car_name_findings, C.imported_name_findings, C.holder_findings]
    rules = [lambda: C.field_findings(x.classified, claims(), x.read), *[partial(lambda f: f(x.classified, claims()), f) for f in by_claims], lambda: C.gst_findings(x.classified)]
    return [partial(lambda f: f().withColumnRenamed("actual", "value"), f) for f in rules]


@check("DUP")
def _dup(x: Inputs) -> list[Rule]:
    return [lambda: U.findings(x.values, x.claims.select("claim", "scope", "status"))]


def chosen(inputs: Inputs, only: Sequence[str] | None = None) -> list[str]:
    """The checks that run: those asked for, or all, whose tables are there. One that is asked for and can't run is an error."""
    keys = list(CHECKS) if only is None else list(only)
    lacking = [k for k in keys if k not in CHECKS or not inputs.has(CHECKS[k].needs)]
    if only is not None and lacking:
        raise ValueError(f"can't run {', '.join(lacking)}")
    return [k for k in keys if k not in lacking]


def run_checks(inputs: Inputs, only: Sequence[str] | None = None) -> DataFrame:
    """Findings of the chosen checks, stored: claim, document, page, code, severity, value, validator. What a check doesn't say is null."""

    def even(rows: DataFrame, key: str) -> DataFrame:
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FINDING.items()]
        return rows.select(*columns, F.lit(key).alias("validator"))

    spark = inputs.pages.sparkSession
    path = own_folder(spark, "findings")
    rules = [(key, rule) for key in chosen(inputs, only) for rule in CHECKS[key].run(inputs)]

    def run(n: int, key: str, rule: Rule) -> str:
        # each has a folder of its own, as writers of one folder would clear each other's unfinished files
        even(rule(), key).write.parquet(f"{path}/{n}")
        return f"{path}/{n}"

    # each rule is a job of its own: one plan of them all would be planned again whenever a part of it is done
    with ThreadPoolExecutor(AT_ONCE) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), n, key, rule) for n, (key, rule) in enumerate(rules)]
        try:
            paths = [job.result() for job in jobs]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)  # what hasn't begun needn't begin
            raise
    kinds = ", ".join(f"{c} {kind}" for c, kind in [*FINDING.items(), ("validator", "string")])
    return spark.read.schema(kinds).parquet(*paths) if paths else spark.createDataFrame([], kinds)


def verdicts(inputs: Inputs, found: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Of each claim for each check that ran: claim, validator, status (FAILED for an error, DOCS_NOT_AVAILABLE without pages, else PASSED), errors, notes.

    One grouping over the findings, which counts in each task first.
    """
    counts = found.groupBy("claim", "validator").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") != "ERROR").alias("notes"))
    keys = F.explode(F.lit(chosen(inputs, only))).alias("validator")
    paged = inputs.classified.select("claim").distinct().withColumn("paged", F.lit(True))
    rows = inputs.claims.select("claim", keys).join(counts, ["claim", "validator"], "left").join(paged, "claim", "left")
    errors = F.coalesce("errors", F.lit(0))
    status = F.when(errors > 0, "FAILED").when(F.col("paged").isNull(), "DOCS_NOT_AVAILABLE").otherwise("PASSED")
    return rows.select("claim", "validator", status.alias("status"), errors.alias("errors"), F.coalesce("notes", F.lit(0)).alias("notes"))
