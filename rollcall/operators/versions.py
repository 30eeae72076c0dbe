"""Several tables changed in one commit: versions of a book of tables, and leads saved into one.

A commit writes the tables that it changes into a folder of its own and then one manifest, which names for every table the
folder that holds it. Readers look at the highest manifest, so they see all of a commit or nothing of it; a job that
dies between tables leaves folders that no manifest names. A manifest is created under its number and never
replaced, so of two commits on one version the second is refused. It also holds the keys of the batches it took
in, so a batch that is sent again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import identity
from rollcall.operators.crawl import ensure_discovered
from rollcall.operators.queue import enqueue
from rollcall.session import new_folder


class Conflict(RuntimeError):
    """Another commit has taken the version's number."""


class Book:
    """Tables under a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: folder}, "batches": [key, ...]} of a version, the last one if none is named."""
        version = self.version() if version is None else version
        if version == 0:
            return {"tables": {}, "batches": []}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{version}", wholetext=True).collect()))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.manifest(version)["tables"][name])

    def commit(self, tables: dict[str, DataFrame], on: int, batch: str | None = None) -> int:
        """Write the tables as the version after `on`; the others stay as they are there. Returns the new version's number."""
        before = self.manifest(on)
        folders = dict(before["tables"])
        for name, table in tables.items():
            folders[name] = f"{self.root}/data/{new_folder(self.spark, name).rsplit('/', 1)[1]}"
            table.write.parquet(folders[name])
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        body = json.dumps({"tables": folders, "batches": [*before["batches"], *([batch] if batch else [])]}).encode()
        part = self._path(f"{self.root}/drafts/{new_folder(self.spark, 'manifest').rsplit('/', 1)[1]}")
        out = self._fs.create(part, False)
        out.write(bytearray(body))
        out.close()
        # a rename onto a name that is taken fails or, on file systems that would replace it, is not tried
        target = self._path(f"{self.root}/manifests/{on + 1}")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise Conflict(f"version {on + 1} was committed meanwhile")
        return on + 1

    def change(self, batch: str, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 3) -> int:
        """Commit make(the tables of the last version) unless the batch is in already; tries again on the version that another
        commit made meanwhile. Returns the last version's number."""
        for left in reversed(range(tries)):
            on = self.version()
            now = self.manifest(on)
            if batch in now["batches"]:
                return on
            try:
                return self.commit(make({n: self.spark.read.parquet(p) for n, p in now["tables"].items()}), on, batch)
            except Conflict:
                if not left:
                    raise
        raise AssertionError


def _clip(c: str, length: int) -> Column:
    return F.substring(c, 1, length).alias(c)


#: Characters that a company's name has in its column; longer ones are cut (a fixed value).
NAME_LENGTH = 512


def save_leads(leads: DataFrame, at: Column) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """A change of the tables ledger, company, contact, validation and queue by leads, for Book.change.

    leads: key, name, country, industry, homepage, is_active, site_alive, confidence, domain, email (the preferred
    address), and contacts array<struct<type, value, role, method, confidence, status, mx, domain_match, smtp, provider>>, an
    address's verdict beside it (status null: not validated). Of several leads of one key the last by name counts.

    The ledger gets a row where it has none. A company's row takes the lead's fields. Its contacts become exactly the
    lead's: those that stay keep their id (it follows from company, kind and value), others go, and their
    verdicts with them; a new verdict replaces an older one, and without a new one an older one stays. The queue takes the addresses in their
    order, also where there are none; a row that is there keeps its status, and a human's choice while it is a candidate.
    """

    def make(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        one = leads.groupBy("key").agg(F.max(F.struct("name", *(c for c in leads.columns if c not in ("key", "name")))).alias("l")).select("key", "l.*")
        one = one.withColumn("company_id", identity.company_id(F.col("key")))
        company = tables["company"]
        fresh = one.select(*(_clip("name", NAME_LENGTH) if c == "name" else F.col("confidence").alias("existence_confidence") if c == "existence_confidence" else F.col(c) if c in one.columns else F.lit(None).cast(company.schema[c].dataType).alias(c) for c in company.columns))
        known = fresh.join(company.select("company_id", *(F.col(c).alias(f"_{c}") for c in company.columns if c not in one.columns and c != "existence_confidence")), "company_id", "left")
        fresh = known.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in known.columns else F.col(c) for c in company.columns))
        companies = company.join(one.select("company_id"), "company_id", "left_anti").select(*company.columns).unionByName(fresh)

        listed = one.select("company_id", F.posexplode("contacts").alias("at", "c")).select("company_id", "at", "c.*")
        listed = listed.withColumn("contact_id", identity.contact_id(F.col("company_id"), F.col("type"), F.col("value")))
        listed = listed.groupBy("contact_id").agg(F.max_by(F.struct(*(c for c in listed.columns if c != "contact_id")), "at").alias("c")).select("contact_id", "c.*")
        contact, validation = tables["contact"], tables["validation"]
        others = contact.join(one.select("company_id"), "company_id", "left_anti").select(*contact.columns)
        contacts = others.unionByName(listed.select(*(F.col(c) for c in contact.columns)))
        said = listed.where("type = 'email' and status is not null").withColumn("checked_at", at)
        kept = validation.join(contacts.select("contact_id"), "contact_id", "left_semi").join(said.select("contact_id"), "contact_id", "left_anti")
        validations = kept.select(*validation.columns).unionByName(said.select(*validation.columns))

        values = F.filter("contacts", lambda c: c["type"] == "email")
        offered = one.select("company_id", identity.review_id(F.col("company_id"), F.lit("email")).alias("review_id"), F.transform(values, lambda c: c["value"]).alias("values"), F.col("email").alias("preferred"))
        return {
            "ledger": ensure_discovered(tables["ledger"], one, at), "company": companies, "contact": contacts,
            "validation": validations, "queue": enqueue(tables["queue"], offered),
        }

    return make
