"""What the dashboard's service answers: one snapshot of a store, with the labelled alarms and the ranked candidates kept between
questions until the store's version changes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, kpis, knowledge, rootcause
from ..sources.base import scratch
from ..sources.store import ParquetStore, to_json


class Service:
    def __init__(self, store: ParquetStore, **segment):
        self.store, self.segment = store, segment

    @cached_property
    def alarms(self) -> DataFrame:
        return self.store.read("alarms")

    @cached_property
    def labelled(self) -> DataFrame:
        return rootcause.labelled(self.alarms, **self.segment).persist()

    @cached_property
    def ranked(self) -> DataFrame:
        return rootcause.rank_candidates(self.labelled).persist()

    @cached_property
    def incidents(self) -> DataFrame:
        return rootcause.incidents(self.labelled).persist()

    def refresh(self) -> None:
        """Forgets what is kept, after the store has changed."""
        for name in ("labelled", "ranked", "incidents"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        self.__dict__.pop("alarms", None)

    def health(self) -> dict:
        return {"status": "ok"}

    def summary(self) -> dict:
        meta = self.store.meta()
        with scratch():
            found = to_json(kpis.summary(self.alarms, self.incidents))
        return found | {"dataset": meta.get("source", "synthetic generator"), "kind": meta.get("kind", "synthetic")}

    def tags_status(self, top: int = 60) -> DataFrame:
        return kpis.tags_status(self.alarms, top)

    def bad_actors(self, top: int = 10) -> DataFrame:
        return analysis.bad_actors(self.alarms, top)

    def chattering(self, top: int = 25) -> DataFrame:
        return analysis.chattering(self.alarms, top=top)

    def floods(self) -> DataFrame:
        return analysis.alarm_floods(self.alarms)

    def co_occurrence(self, top: int = 25) -> DataFrame:
        return analysis.co_occurrence(self.alarms, top=top)

    def sequences(self) -> DataFrame:
        return analysis.pre_incident_sequences(self.alarms)

    def kpis(self) -> dict:
        with scratch():
            return to_json(kpis.summary_kpis(self.alarms, self.store.read("episodes")))

    def incident_list(self, top: int = 40) -> DataFrame:
        return rootcause.largest(self.incidents, top)

    def root_cause(self, top: int = 40) -> DataFrame:
        return rootcause.of_largest(self.ranked, self.incidents, top)

    def cause_hints(self) -> DataFrame:
        return rootcause.cause_hints(self.ranked)

    def signatures(self) -> DataFrame:
        return rootcause.signatures(self.ranked, self.incidents)

    def recommendations(self, incident_id: str | None = None, top: int = 12) -> DataFrame:
        chosen = self.incidents.where(F.col("incident_id") == incident_id) if incident_id else rootcause.largest(self.incidents, top)
        some = chosen.select("incident_id")
        ranked = self.ranked.join(some, "incident_id", "left_semi")
        matches = knowledge.match(self.signatures().join(some, "incident_id", "left_semi"), self.store.read("kb_confirmations"))
        return knowledge.recommend(ranked, chattering=analysis.chattering(self.alarms, top=60), co_occurrence=analysis.co_occurrence(self.alarms, top=60), matches=matches)

    def recommendation_answers(self, incident_id: str | None = None, top: int = 12) -> DataFrame:
        """One row for each incident, with its signature, whether its case is known, and its recommendations."""
        matches = knowledge.match(self.signatures(), self.store.read("kb_confirmations"))
        return knowledge.answers(self.recommendations(incident_id, top), self.signatures(), matches)

    def record_incidents(self, unit: str | None = None) -> int:
        """Appends the incidents that the store doesn't hold yet, their alarms and their candidates, under ids that later runs keep; returns
        how many. An incident that shares time with one of the store is known, also if earlier or late alarms have changed its bounds or its number.
        The three tables are one batch: a run that dies leaves nothing of it, and the next one writes all of it."""
        rows = rootcause.stable_ids(self.labelled).persist()
        found = rootcause.incidents(rows)
        new = found.join(rootcause.known_incidents(found, self.store.read("incidents")), "incident_id", "left_anti").persist()
        n = new.count()
        if n:
            chosen = lambda df: df.join(new.select("incident_id"), "incident_id", "left_semi")
            with self.store.batch() as batch:
                for name, table in knowledge.incident_tables(chosen(rows), chosen(rootcause.rank_candidates(rows)), new, unit).items():
                    batch.append(table, name)
        new.unpersist()
        rows.unpersist()
        return n

    def confirm(self, incident_id: str, *, confirmed_cause: str | None = None, action_taken: str = "", operator: str = "operator", correct: bool | None = None) -> dict:
        """Appends a confirmation; prior_matches is how many others of its signature the store then holds."""
        one = self.signatures().where(F.col("incident_id") == incident_id)
        row = knowledge.confirmation(one, self.ranked, cause=confirmed_cause, action=action_taken, operator=operator, correct=correct).persist()
        found = row.first()
        if found is None:
            return {"error": "unknown incident"}
        self.store.append(row, "kb_confirmations")
        row.unpersist()
        seen = knowledge.count_signature(self.store.read("kb_confirmations"), found["signature"]).first()["n"]
        return {"confirmation_id": found["id"], "signature": found["signature"], "prior_matches": seen - 1}

    def kb(self, top: int = 100) -> DataFrame:
        return knowledge.newest(self.store.read("kb_confirmations"), top)

    def kb_stats(self) -> dict:
        history = self.store.read("kb_confirmations")
        return to_json(knowledge.stats(history)) | {"engine_accuracy": to_json(knowledge.engine_accuracy(history))}

    def payload_text(self) -> Iterator[str]:
        """Everything the dashboard shows as pieces of one JSON object, for a file that it reads offline. Lists are whole; those of floods and cause
        hints have no limit of their own, so the driver takes a list's rows one partition at a time."""
        lists = {
            "tags_status": self.tags_status(), "bad_actors": self.bad_actors(), "chattering": self.chattering(15), "floods": self.floods().orderBy(F.desc("window_start")), "co_occurrence": self.co_occurrence(20),
            "sequences": self.sequences(), "incidents": self.incident_list(60), "root_cause": self.root_cause(60), "recommendations": self.recommendation_answers(),
        }
        as_json = lambda row: F.to_json(row, {"ignoreNullFields": "false"}).alias("j")
        hints = self.cause_hints().orderBy("tag").select(as_json(F.create_map("tag", "hint")))
        yield "{" + ", ".join(f'"{k}": {json.dumps(v, ensure_ascii=False)}' for k, v in (("summary", self.summary()), ("kpis", self.kpis()), ("kb_stats", self.kb_stats())))
        for name, df, (opening, closing), cut in (*((k, df.select(as_json(F.struct("*"))), "[]", slice(None)) for k, df in lists.items()), ("cause_hints", hints, "{}", slice(1, -1))):
            yield f', "{name}": {opening}'
            for k, row in enumerate(df.toLocalIterator()):
                yield (", " if k else "") + row["j"][cut]
            yield closing
        yield "}"

    def payload(self) -> dict:
        return json.loads("".join(self.payload_text()))
