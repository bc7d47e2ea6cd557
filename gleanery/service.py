"""The engine behind one object: search, pages, groups, neighbours, builds and settings; and background builds."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import storage
from gleanery.cluster import ship
from gleanery.config import Config
from gleanery.operators import fts, hybrid, incremental, retrieval, vector
from gleanery.operators import index as ix
from gleanery.operators.index import Index
from gleanery.sources import corpus, discovery
from gleanery.sources.embedding import EmbeddingError, Service


@dataclass
class Job:
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "running"
    stage: str = ""
    result: dict | None = None
    error: str | None = None


class Jobs:
    """One background job at a time; its Spark jobs run in a group of their own and can be cancelled together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.jobs = spark, threading.Lock(), {}

    def start(self, work) -> Job:
        with self.lock:
            if any(j.status == "running" for j in self.jobs.values()):
                raise RuntimeError("a job is running")
            job = Job()
            self.jobs[job.id] = job
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return job

    def _run(self, job: Job, work) -> None:
        self.spark.sparkContext.setJobGroup(job.id, "build", interruptOnCancel=True)
        try:
            job.result = work(lambda stage: setattr(job, "stage", stage))
            job.status = "done"
        except Exception as e:
            job.error, job.status = f"{type(e).__name__}: {e}", "error"

    def get(self, job_id: str) -> Job:
        return self.jobs[job_id]

    def cancel(self, job_id: str) -> None:
        self.spark.sparkContext.cancelJobGroup(job_id)


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = ship(spark), config or Config()
        self.jobs = Jobs(spark)
        self._held: tuple[str, Index] | None = None

    def index(self) -> Index:
        """The published index, kept until another version is published."""
        version = storage.current_version(self.spark, self.config.index)
        if self._held is None or self._held[0] != version:
            self._held = (version, Index.read(self.spark, self.config.index))
        return self._held[1]

    # --- search ---

    def search_all(self, queries: DataFrame, *, limit: int | None = None, section: str | None = None, kind: str | None = None, backend: str | None = None) -> DataFrame:
        """A batch of (query_id, query[, vec]) rows in one plan. Unknown backends mean full-text search."""
        s = self.config.search
        args = {"limit": limit or s.limit, "per_page": s.max_chunks_per_page, "section": section, "kind": kind}
        run = {"vectors": vector.search, "hybrid": hybrid.search}.get((backend or s.backend).lower(), fts.search)
        return run(self.index(), queries, **args)

    def search(self, query: str, section: str | None = None, kind: str | None = None, limit: int | None = None) -> dict:
        """One query; without a reachable embedder or vectors the full-text search answers."""
        name = self.config.search.backend.lower()
        rows = [(0, query)]
        plain = self.spark.createDataFrame(rows, "query_id long, query string")
        try:
            if name in ("vectors", "hybrid"):
                if self.index().vectors is None:
                    raise EmbeddingError("the index has no vectors")
                e = self.config.query_embedder()
                made = Service(e.model, e.base_url, e.api_key, e.dims, e.batch_size, e.threads, e.provider or "openai").embed([query])
                asked = self.spark.createDataFrame([(0, query, [float(x) for x in made[0]])], "query_id long, query string, vec array<double>").withColumn("vec", vector.unit(F.col("vec")))
                found = self.search_all(asked, limit=limit, section=section, kind=kind)
            else:
                found = self.search_all(plain, limit=limit, section=section, kind=kind)
        except EmbeddingError:
            found, name = self.search_all(plain, limit=limit, section=section, kind=kind, backend="fts"), "fts (fallback)"
        results = [{k: r[k] for k in ("rank", *fts.RESULT)} for r in found.orderBy("rank").collect()]
        return {"count": len(results), "backend": name, "results": results}

    # --- pages ---

    def get_page(self, id: str | list[str], chunk: int | None = None, max_chars: int = retrieval.PAGE_CHARS) -> dict:
        if isinstance(id, list):
            return retrieval.get_pages(self.index(), id, max_chars)
        if isinstance(id, str):
            return retrieval.get_page(self.index(), id, chunk)
        raise ValueError("id is a string or a list of strings")

    def hierarchy(self, section: str | None = None) -> dict:
        return retrieval.hierarchy(self.index(), section)

    def related(self, id: str) -> dict:
        return retrieval.related(self.index(), id)

    def discover(self) -> dict:
        there = storage.current_version(self.spark, self.config.index) is not None
        return {"installations": discovery.installations(), "config": self.config.to_dict(), "index": {"exists": there} | (self.index().stats() if there else {})}

    # --- builds and settings ---

    def _params(self, config: Config) -> dict[str, str]:
        b, e = config.build, config.embedder.index
        return {"chunk_size": str(b.chunk_size), "chunk_overlap": str(b.chunk_overlap), "embed_model": e.model, "embed_dims": str(e.dims), "link_scheme": config.link_scheme}

    def build_now(self, *, force: bool = False, say=lambda stage: None, docs: DataFrame | None = None, sources: list[str] | None = None, lang: str | None = None, **settings) -> dict:
        """Build the index from the sources (else the corpus folder, or ``docs``) with settings of this build alone; skipped
        if nothing changed.  ``failed`` lists what could not be read or converted."""
        config = Config()
        config.update(self.config.to_dict())
        config.update({"build": config.build.__dict__ | settings})
        own, failed = docs is None, []
        with storage.scope():
            if own:
                say("convert")
                docs, failed = corpus.consolidated(self.spark, config, lang, sources)
            say("hash")
            rows = docs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("filename", "text").cast("decimal(38,0)"))).first()
            params = self._params(config) | {"corpus": f"{rows[0]}:{rows[1]}"}
            if not force and storage.current_version(self.spark, config.index) is not None:
                old = self.index()
                meta = {r["key"]: r["value"] for r in old.meta.collect()} if old.meta is not None else {}
                if incremental.up_to_date(meta, params):
                    return {"skipped": True, "failed": failed} | old.stats()
            say("index")
            made = ix.build(docs, size=config.build.chunk_size, overlap=config.build.chunk_overlap, params=params, scheme=config.link_scheme)
            self._embed(made, config, params["corpus"], say)
            say("publish")
            made.publish(config.index)
        if config.build.cleanup and own and not config.sources_for(lang, sources):
            storage.drop(self.spark, config.corpus)
        return {"skipped": False, "failed": failed} | self.index().stats()

    def _embed(self, made: Index, config: Config, mark: str, say) -> None:
        e = config.embedder.index
        if e.complete:
            say("embed")
            at = f"{config.index}/vectors-{mark.replace(':', '-')}-{e.model.replace('/', '_')}-{config.build.chunk_size}-{config.build.chunk_overlap}"
            incremental.embed_pending(made, at, Service(e.model, e.base_url, e.api_key, e.dims, e.batch_size, e.threads, e.provider or "openai").client(), batch=e.batch_size)
            new = self.spark.read.parquet(at).dropDuplicates(["chunk_id"])
            made.vectors = new if made.vectors is None else made.vectors.unionByName(new)

    def add_source(self, id: str, *, embed: bool = True, say=lambda stage: None) -> dict:
        """Convert one book and add its pages to the published index; pages that are there stay as they are."""
        mine = [s for s in self.config.sources if s.id == id]
        if not mine:
            raise LookupError(f"no such source: {id}")
        with storage.scope():
            say("convert")
            pages, failed = corpus.books(self.spark, mine, self.config.containers or discovery.newest(), self.config.link_scheme)
            old = self.index()
            say("index")
            grown = incremental.append(old, pages)
            if grown is not old:
                if embed:
                    self._embed(grown, self.config, f"{id}-{storage.current_version(self.spark, self.config.index)}", say)
                say("publish")
                grown.publish(self.config.index)
        return {"failed": failed} | self.index().stats()

    def rebuild_text(self) -> dict:
        """Publish the index with its full-text tables made anew."""
        with storage.scope():
            ix.rebuild_text(self.index(), self.config.index)
        return self.index().stats()

    def build(self, *, force: bool = False, **settings) -> dict:
        job = self.jobs.start(lambda say: self.build_now(force=force, say=say, **settings))
        return {"job_id": job.id, "status": job.status}

    def build_status(self, job_id: str) -> dict:
        j = self.jobs.get(job_id)
        return {"id": j.id, "status": j.status, "stage": j.stage, "error": j.error} | (j.result or {})

    def config_get(self) -> dict:
        return self.config.to_dict()

    def config_set(self, values: dict, path: str | None = None) -> dict:
        self.config.update(values)
        if path:
            self.config.save(path)
        return self.config.to_dict()
