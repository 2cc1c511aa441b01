"""Deliveries of two providers as one stream: signatures and tokens checked, payloads brought to one form, repeats told, and
the state of each change kept across restarts.

A change (repository and number) has a status, open, closed or merged, that its latest event by time sets, so late deliveries
of earlier events change nothing. Ids of deliveries are remembered for each change, first in, first out. Both lie in the
state store: nothing is kept in a process, and a stream that is started again from its checkpoint goes on.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..shipping import ship

#: The provider of state that stateful processors need; a session must be set to it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Ids that a change remembers at most.
REMEMBERED = 10_000
# The events and actions that change a change, and what a payload without a commit has.
ACTIONS = ["opened", "synchronize", "reopened", "closed"]
NO_COMMIT = "0" * 40

_A = """struct<action: string, repository: struct<full_name: string, id: string>, pull_request: struct<number: long, title: string, body: string, state: string, merged: boolean, updated_at: timestamp,
  user: struct<login: string>, head: struct<ref: string, sha: string>, base: struct<ref: string, sha: string>>>"""
_B = """struct<object_kind: string, user: struct<username: string>, project: struct<path_with_namespace: string, name: string>, object_attributes: struct<iid: long, id: long, title: string, description: string, action: string, state: string,
  updated_at: timestamp, source_branch: string, target_branch: string, last_commit: struct<id: string>, diff_head_sha: string, target: struct<id: string>, diff_base_sha: string>>"""


def hmac_sha256(message: Column, key: str) -> Column:
    """The HMAC of a text's bytes, as hex, by two SHA-256 digests."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def routed(received: DataFrame, secret: str, token: str) -> DataFrame:
    """Adds ``outcome`` and, for what changes a change, its fields in one form.

    ``received`` has provider (a or b), signature (a's digest, b's token), delivery, event and body (JSON). Outcomes:
    unsigned, forged, ignored_event, ignored_action, malformed, change. Fields are repository, number, title, author,
    source, target, head, base, status, at; they are null where the outcome is another. Null bodies are malformed."""
    a, b = F.from_json("body", _A), F.from_json("body", _B)
    first = F.col("provider") == "a"
    pr, mr = F.col("__a.pull_request"), F.col("__b.object_attributes")
    good = F.when(first, F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(F.coalesce("body", F.lit("")), secret))).otherwise(F.col("signature") == token)
    either = lambda x, y: F.when(first, x).otherwise(y)
    closed = either((F.col("__a.action") == "closed") | F.coalesce(pr["state"] == "closed", F.lit(False)), F.coalesce(mr["action"].isin("close", "merge"), F.lit(False)) | F.coalesce(mr["state"].isin("closed", "merged"), F.lit(False)))
    merged = either(F.coalesce(pr["merged"], F.lit(False)), F.coalesce(mr["action"] == "merge", F.lit(False)) | F.coalesce(mr["state"] == "merged", F.lit(False)))
    fields = {
        "repository": F.lower(either(F.col("__a.repository.full_name"), F.coalesce("__b.project.path_with_namespace", "__b.project.name"))),
        "number": either(pr["number"], F.coalesce(mr["iid"], mr["id"])),
        "title": either(F.coalesce(pr["title"], F.lit("Untitled PR")), F.coalesce(mr["title"], F.lit("Untitled MR"))),
        "author": F.coalesce(either(pr["user"]["login"], F.col("__b.user.username")), F.lit("unknown")),
        "source": either(pr["head"]["ref"], mr["source_branch"]), "target": either(pr["base"]["ref"], mr["target_branch"]),
        "head": either(pr["head"]["sha"], F.coalesce(mr["last_commit"]["id"], mr["diff_head_sha"], F.lit(NO_COMMIT))), "base": either(pr["base"]["sha"], F.coalesce(mr["target"]["id"], mr["diff_base_sha"], F.lit(NO_COMMIT))),
        "status": F.when(~closed, "open").when(merged, "merged").otherwise("closed"), "at": either(pr["updated_at"], mr["updated_at"]),
    }
    rows = received.withColumns({"__a": F.when(first, a), "__b": F.when(~first, b)}).withColumns({f"__{k}": v for k, v in fields.items()})
    outcome = (
        F.when(F.col("signature").isNull(), "unsigned").when(~F.coalesce(good, F.lit(False)), "forged")
        .when(~F.coalesce(either(F.col("event") == "pull_request", F.col("__b.object_kind") == "merge_request"), F.lit(False)), "ignored_event")
        .when(first & ~F.coalesce(F.col("__a.action").isin(ACTIONS), F.lit(False)), "ignored_action")
        .when(F.col("__repository").isNull() | F.col("__number").isNull() | F.col("__at").isNull(), "malformed").otherwise("change")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select("provider", "delivery", "outcome", *[F.when(F.col("outcome") == "change", F.col(f"__{k}")).alias(k) for k in fields])


def _processor(remembered: int, ids_ttl: int | None, status_ttl: int | None) -> StatefulProcessor:
    """The state of one change. A class of its own for each call, as such travel to the driver's stream runner whole."""

    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.status = handle.getValueState("status", "status string, at timestamp, delivery string", status_ttl)
            self.seen = handle.getValueState("seen", "ids array<string>", ids_ttl)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            # state is read and written once for all rows of a change, as each access is a message to the state store
            before = known = self.status.get() if self.status.exists() else None
            order = deque(self.seen.get()[0]) if self.seen.exists() else deque()
            ids, out, new = set(order), [], False
            for part in rows:
                for r in part.itertuples(index=False):
                    delivery = r.delivery if isinstance(r.delivery, str) else None
                    repeat = delivery is not None and delivery in ids
                    if delivery is not None and not repeat:
                        if len(order) >= remembered:
                            ids.discard(order.popleft())
                        order.append(delivery)
                        ids.add(delivery)
                        new = True
                    at, tie = pd.Timestamp(r.at), delivery or ""
                    newer = not repeat and (known is None or (at, tie) >= (pd.Timestamp(known[1]), known[2]))
                    if newer:
                        known = (r.status, at.to_pydatetime(), tie)
                    out.append((*key, r.provider, delivery, at, repeat, newer, known[0], newer and known[0] == "open"))
            if known != before:
                self.status.update(known)
            if new:
                self.seen.update((list(order),))
            yield pd.DataFrame(out, columns=["repository", "number", "provider", "delivery", "at", "repeated", "applied", "status", "analysed"])

        def close(self) -> None:
            pass

    return Changes()


def changes(deliveries: DataFrame, remembered: int = REMEMBERED, ids_ttl: int | None = None, status_ttl: int | None = None) -> DataFrame:
    """Each delivery of a change with what it did: repeated (its id came before, null ids never), applied (no later event is
    known, ties by the delivery's id), status (of the change after it) and analysed (applied and open; closed ones are not).

    ``deliveries`` is a stream of what :func:`routed` calls a change. A change remembers its last ``remembered`` ids, for
    ``ids_ttl`` milliseconds, and its status for ``status_ttl`` (null: for good). With either, time passes without input too,
    so such a stream never runs dry: it needs a trigger other than availableNow."""
    ship(deliveries.sparkSession)
    keyed = deliveries.select("repository", "number", "provider", "delivery", "status", "at").groupBy("repository", "number")
    schema = "repository string, number long, provider string, delivery string, at timestamp, repeated boolean, applied boolean, status string, analysed boolean"
    return keyed.transformWithStateInPandas(_processor(remembered, ids_ttl, status_ttl), schema, "Append", "None" if ids_ttl is None and status_ttl is None else "ProcessingTime")
