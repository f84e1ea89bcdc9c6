"""The registered queries: each applies operators to the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, backend
from ..functions import context as ctx
from ..functions import hashing, text
from ..operators import delivery, errors, identity, issues, panes, records, restore
from ..schema import settings
from ..sources import shared, tables

CFG = backend(source="Check App", session_id="session_0")
N, WINDOW = 3, 6 * 3_600_000
AS_OF = 1_706_745_600_000  # 2024-02-01


def issue_config() -> Config:
    return Config.resolve(source="Check App", session_id="session_0", errors={"threshold_count": N, "threshold_window_ms": WINDOW})


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select("doc_id", "text", "source")


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with optional fields missing here and there."""
    e, s = tables.events(spark, d), F.col("seq")
    return e.withColumns(
        {
            "kind": F.when(s % 5 == 0, None).when(s % 5 == 1, "odd").otherwise(F.col("kind")),
            "channel": F.when(s % 4 == 0, None).otherwise(F.col("channel")),
            "label": F.when(s % 2 == 0, F.concat(F.lit("label "), "k")),
            "href": F.concat(F.lit("/p?token=x&k="), "k"),
            "request_id": F.when(s % 3 == 0, F.concat(F.lit("\t req_"), s, F.lit(" \n"))).when(s % 3 == 1, " \t\u00a0\n"),
            "timestamp": F.when(s % 11 == 0, None).otherwise(F.col("timestamp")),
        }
    )


_RECORD = ["id", "seq", "kind", "component", "action", "channel", "runtime", "label", "href", "variant", "request_id", "source", "session_id", "timestamp", "context"]


def events_normalize(spark, d):
    return records.normalize_events(_raw_events(spark, d), CFG, now_ms=AS_OF).select(*_RECORD)


def events_mixed_channels(spark, d):
    e = tables.events(spark, d)
    both = records.mixed_channels(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))
    return records.normalize_events(both, CFG).select("seq", "channel", "runtime", "context")


def events_component_bound(spark, d):
    rows = tables.events(spark, d).select("seq", "id", "action", "kind", "timestamp", "context")
    bound = records.bind_component("panel", {"area": "main", "k": 0})(rows)
    return records.normalize_events(bound, CFG, now_ms=AS_OF).select("id", "kind", "component", "action", "context")


def events_disabled(spark, d):
    return records.normalize_events(tables.events(spark, d), replace(CFG, enabled=False)).select("id", "component", "action")


def _embedded(spark, d):
    s, k = F.col("seq"), F.col("k")
    error = F.struct(F.concat(F.lit(" box\t"), k % 4).alias("boundary"), F.lit("TypeError").alias("name"), F.when(s % 3 != 0, F.concat(F.lit("user"), k, F.lit("@mail.example.org failed"))).alias("message"), F.when(s % 2 == 0, F.lit("err_known")).otherwise(" ").alias("fingerprint"), F.lit(None).cast("boolean").alias("handled"), F.when(k % 2 == 0, "fatal").otherwise("bad").alias("severity"), F.lit("a@b.co line\n\n  at f ").alias("stack"), F.lit(None).cast("string").alias("component_stack"), F.array(F.lit("x"), F.lit(" x "), F.lit("")).alias("tags"))
    return tables.events(spark, d).withColumn("error", error)


def events_with_error(spark, d):
    r = records.normalize_events(_embedded(spark, d), CFG)
    return r.select("id", "kind", *[F.col(f"error.{c}").alias(f"error_{c}") for c in ("boundary", "name", "message", "fingerprint", "handled", "severity", "stack")], F.array_join("error.tags", "|").alias("error_tags"))


def _reports(spark, d):
    """Documents as error reports."""
    i = F.col("doc_id")
    error = F.struct(F.when(i % 5 == 0, " ").when(i % 5 == 1, None).otherwise(F.concat(F.lit("Name"), i % 7)).alias("name"), F.col("text").alias("message"), F.when(i % 2 == 0, F.col("text")).alias("stack"))
    return _docs(spark, d).select("doc_id", F.col("source").alias("boundary"), error.alias("error"), F.col("text").alias("component_stack"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("handled"), F.when(i % 4 == 0, "fatal").alias("severity"), F.split("text", " ").alias("tags"))


def errors_normalize(spark, d):
    n = errors.normalize_errors(_reports(spark, d), CFG)
    return n.select("doc_id", *[F.col(f"details.{c}").alias(c) for c in ("boundary", "name", "message", "fingerprint", "handled", "severity", "stack", "component_stack")], F.array_join("details.tags", "|").alias("tags"))


def errors_extract(spark, d):
    i = F.col("doc_id")
    error = F.when(i % 4 < 2, F.struct(F.when(i % 2 == 0, "Named").otherwise("  ").alias("name"), F.when(i % 8 < 4, F.col("source")).otherwise("").alias("message"), F.lit("s").alias("stack")))
    thrown = F.when(i % 8 == 7, "other").when(i % 8 == 4, "error")
    e = errors.extract(_docs(spark, d).withColumns({"error": error, "raw": F.when((i % 4 == 2) | (i % 16 == 7), F.col("text")), "thrown": thrown}))
    return e.select("doc_id", F.col("_name").alias("name"), F.col("_message").alias("message"), F.col("_stack").alias("stack"))


def errors_to_records(spark, d):
    r = errors.errors_to_records(tables.reports(spark, d), CFG)
    return r.select("id", "seq", "kind", "component", "action", "channel", "runtime", "label", "source", "session_id", "timestamp")


def errors_context(spark, d):
    r = errors.errors_to_records(tables.reports(spark, d).withColumn("context", F.concat(F.lit('{"errorHandled":"no","userId":'), "user_id", F.lit(',"step":"a  b"}'))), CFG)
    get = lambda p: F.get_json_object("context", f"$.{p}")
    return r.select("id", get("errorFingerprint").alias("fingerprint"), get("errorBoundary").alias("boundary"), get("errorSeverity").alias("severity"), get("errorHandled").alias("handled"), get("userId").alias("user"), get("step").alias("step"), get("clientIdentity.sessionIdHash").alias("session_hash"), get("clientIdentity.identifiers[0].key").alias("identifier"), get("clientIdentity.identifiers[0].valueHash").alias("value_hash"), get("analyticsChannel").alias("channel"))


def errors_gated(spark, d):
    closed = Config.resolve(source="Check App", session_id="session_0", endpoint="http://remote.example.com/in")
    open_ = Config.resolve(previous=closed, endpoint="https://remote.example.com/in")
    off = Config.resolve(previous=open_, errors={"enabled": False})
    e = tables.reports(spark, d).select("seq", "boundary")
    parts = [errors.gated(e, c).withColumn("endpoint", F.lit(n)) for n, c in (("refused", closed), ("open", open_), ("off", off))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def context_merge(spark, d):
    default = F.create_map(F.lit("k"), F.lit("none"), F.lit("app"), F.lit("check"))
    e = tables.events(spark, d).withColumn("m", records.merge_maps(default, F.from_json("context", "map<string,string>")))
    return e.select("id", F.col("m")["k"].alias("k"), F.col("m")["app"].alias("app"), F.size("m").alias("n_keys"))


def context_inject(spark, d):
    s = F.col("seq")
    own = F.when(s % 3 == 0, F.lit('{"analyticsChannel":null}')).when(s % 3 == 1, F.lit("{ }")).otherwise(F.col("context"))
    return tables.events(spark, d).select("id", records.inject_channel(own, F.col("channel"), F.lit("server")).alias("context"))


def endpoint_secure(spark, d):
    i, u = F.col("page_id"), F.col("url")
    path = F.regexp_replace(u, "^https?://", "")
    e = F.when(i % 8 == 0, F.concat(F.lit("http://LOCALHOST:8080/"), i)).when(i % 8 == 1, F.lit("  ")).when(i % 8 == 2, F.concat(F.lit("//"), path)).when(i % 8 == 3, F.concat(F.lit("/"), path)).when(i % 8 == 4, F.concat(F.lit("http://127.0.0.1/"), i)).otherwise(u)
    return tables.read(spark, d, "pages").select("page_id", e.alias("endpoint")).select("page_id", text.secure_endpoint(F.col("endpoint")).alias("secure"))


def _turns(spark, d):
    c = tables.read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("queue_key"), F.col("turn").alias("seq"), F.col("role").alias("kind"), F.concat(F.lit("t_"), "conv_id", F.lit("_"), "turn").alias("id"))


def _queued(spark, d):
    """Records of clients: one per session."""
    return tables.events(spark, d).withColumn("queue_key", F.col("session_id"))


def queue_cap(spark, d):
    return delivery.queue_cap(_turns(spark, d), 2).select("queue_key", "seq", "id")


def flush_batches(spark, d):
    return delivery.cut_batches(_turns(spark, d), 3).select("queue_key", "seq", "batch_no", "batch_pos")


def flush_envelopes(spark, d):
    b = delivery.cut_batches(_queued(spark, d).drop("user_id", "value", "k"), CFG.batch_size)
    return delivery.envelopes(b, CFG, sent_at_ms=AS_OF).select("queue_key", "batch_no", "source", "channel", "runtime", "sent_at", "n_events", "first_seq", "last_seq", "body")


def batch_admission(spark, d):
    b = delivery.cut_batches(_queued(spark, d), 2)
    endpoint = F.when(F.col("batch_no") % 3 == 0, "http://remote.example.com/in").when(F.col("batch_no") % 3 == 1, "https://remote.example.com/in").otherwise("")
    return delivery.admission(b.withColumn("endpoint", endpoint), F.col("endpoint"), True, ["queue_key", "batch_no"])


def _contexts(spark, d):
    """Flat objects, some with more keys than the breadth."""
    many = ",".join(f'"z{i:02d}":"{i}"' for i in range(25))
    c = F.concat(F.lit('{"userId":"u'), "user_id", F.lit('","feature":" f\\t'), "k", F.lit('","contact":"mail me at a'), "k", F.lit('@b.example","Authorization":"key'), F.col("k") % 5, F.lit('"'), F.when(F.col("k") % 2 == 0, F.lit("," + many)).otherwise(""), F.lit(',"last":null}'))
    return tables.events(spark, d).select("id", c.alias("context"))


def context_redact(spark, d):
    c = _contexts(spark, d).withColumn("m", ctx.clean_flat(F.col("context"), CFG.errors))
    return c.select("id", *[F.col("m")[k].alias(k.lower()) for k in ("userId", "feature", "contact", "Authorization", "z03", "z20", "last")])


def context_breadth(spark, d):
    e = ctx.flat_entries(F.col("context"), CFG.errors.max_context_breadth)
    return _contexts(spark, d).select("id", F.size(e).alias("n_entries"), F.array_join(F.transform(e, lambda x: x["key"]), ",").alias("entry_keys"))


def _tree_query(spark, d, clean):
    s = F.col("seq")
    tree = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":1}},"email":"x@y.example"}},"list":[{"token":"t'), s, F.lit('"},[1,2.5,null]],"n":'), "k", F.lit("}"))
    t = tables.events(spark, d).select("id", clean(tree, CFG.errors).alias("t"))
    return t.select("id", F.col("t.context").alias("context"), F.to_json("t.identifiers").alias("identifiers"))


def context_tree(spark, d):
    return _tree_query(spark, d, ctx.clean_tree)


def context_tree_native(spark, d):
    return _tree_query(spark, d, ctx.clean_tree_native)


def identifiers_explode(spark, d):
    i = ctx.flat_identifiers(F.col("context"), CFG.errors)
    return _contexts(spark, d).select(F.col("id").alias("record_id"), F.posexplode(i).alias("pos", "e")).select("record_id", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"), identity.pseudonym(F.col("e.value")).alias("value_hash"))


def redact_text(spark, d):
    return _docs(spark, d).select("doc_id", text.redact(F.col("text")).alias("redacted"))


def sanitize_single_line(spark, d):
    return _docs(spark, d).select("doc_id", text.single_line(F.col("text"), 240).alias("line"))


def sanitize_multiline(spark, d):
    return _docs(spark, d).select("doc_id", text.multi_line(F.col("text"), 1800).alias("lines"))


def tags_normalize(spark, d):
    words = F.split("text", "[ \n]")
    t = text.tags(F.concat(words, F.array(F.lit(" "), F.lit("last"))), 10, 240)
    return _docs(spark, d).select("doc_id", F.array_join(t, "|").alias("tags"), F.size(t).alias("n_tags"))


def storage_key(spark, d):
    source = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" My App/"), "text"))
    return _docs(spark, d).select("doc_id", text.storage_key(source, F.lit("backend")).alias("storage_key"))


def string_hash(spark, d):
    return _docs(spark, d).select("doc_id", hashing.string_hash(F.col("text")).alias("hash"))


def storage_hash(spark, d):
    return tables.events(spark, d).select("id", hashing.storage_hash(F.col("session_id")).alias("session_hash"), hashing.storage_hash(F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("context"))).alias("context_hash"))


def fingerprint(spark, d):
    return tables.reports(spark, d).select("id", hashing.fingerprint(F.col("boundary"), F.col("error.name"), F.col("error.message"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("at f"), "k", F.lit("\nat g"))), F.lit("error")).alias("fingerprint"))


def crash_identity(spark, d):
    cfg = replace(CFG, runtime="browser", channel="frontend")
    e = tables.events(spark, d).withColumns({"user_agent": F.concat(F.lit("agent/"), F.col("k")), "language": F.when(F.col("k") % 2 == 0, "de").otherwise("en"), "screen_width": (F.col("k") * 10).cast("int")})
    i = identity.crash_identity(e, cfg)
    return e.select("id", i.alias("i")).select("id", *[F.col(f"i.{c}").alias(n) for c, n in (("source", "source"), ("channel", "channel"), ("sessionIdHash", "session_hash"), ("userAgentHash", "agent_hash"), ("languageHash", "language_hash"), ("screenWidth", "screen_width"))])


def _issues(spark, d):
    return issues.issue_reports(tables.error_records(spark, d), 7 * 86_400_000, AS_OF - 86_400_000)


def issue_reports(spark, d):
    return _issues(spark, d).select("fingerprint", "boundary", "count", "first_seen", "last_seen", "severity", F.col("sample.name").alias("sample_name"))


def issue_reports_panes(spark, d):
    """The same from a store of panes that took the errors up in two batches, the later ones first."""
    e = tables.error_records(spark, d)
    store = panes.IssuePanes(spark, shared.new_path(spark, "panes"), 3_600_000)
    middle = F.col("timestamp") >= 1_705_500_000_000
    store.add(e.where(middle), 0)
    store.add(e.where(~middle), 1)
    r = store.reports(7 * 86_400_000, AS_OF - 86_400_000)
    return r.select("fingerprint", "boundary", "count", "first_seen", "last_seen", "severity", F.col("sample.name").alias("sample_name"))


def issue_reports_ranked(spark, d):
    return issues.placed(_issues(spark, d)).select("place", "fingerprint", "count", "last_seen")


def _own_issues(spark, d):
    """Every session's errors are an issue of their own."""
    r = tables.error_records(spark, d)
    mark = F.concat(F.lit("f"), F.pmod(F.col("seq") * 7919, F.lit(1009)))
    return r.withColumn("error", F.col("error").withField("fingerprint", mark))


def issue_reports_ranked_all(spark, d):
    """A thousand issues, with ties."""
    r = issues.issue_reports(_own_issues(spark, d), 7 * 86_400_000, AS_OF - 86_400_000)
    return issues.placed(r).select("place", "fingerprint", "count", "last_seen")


def issue_window_count(spark, d):
    return issues.window_counts(tables.error_records(spark, d), WINDOW)


def issue_window_count_late(spark, d):
    r = tables.error_records(spark, d).withColumn("seq", (F.col("seq") * 7919) % 100_003)
    return issues.folded_counts(r, WINDOW)


def issue_triggers_late(spark, d):
    r = tables.error_records(spark, d).withColumn("seq", (F.col("seq") * 7919) % 100_003)
    t = issues.trigger_rows(r, issue_config(), in_order=False)
    return t.select("seq", "fired_at", F.col("report.fingerprint").alias("fingerprint"), F.col("report.count").alias("count"))


def issue_reports_of_errors(spark, d):
    """Issues of whole error reports, with fingerprints computed from them."""
    r = issues.issue_reports(errors.errors_to_records(tables.reports(spark, d), CFG), 7 * 86_400_000, AS_OF - 86_400_000)
    return r.select("fingerprint", "boundary", "count", "first_seen", "last_seen", "severity", F.col("sample.message").alias("message"))


def issue_triggers(spark, d):
    t = issues.trigger_rows(tables.error_records(spark, d), issue_config())
    return t.select("source", "channel", "runtime", "threshold_count", "window_ms", "seq", "fired_at", F.col("report.fingerprint").alias("fingerprint"), F.col("report.count").alias("count"), F.col("report.severity").alias("severity"))


def issue_seeded(spark, d):
    e = tables.error_records(spark, d)
    old = e.where(F.col("timestamp") < 1_704_672_000_000)
    return issues.seeded_triggers(old, e.where(F.col("timestamp") >= 1_704_672_000_000), issue_config())


def _persisted(spark, d):
    """Arrays of stored records, each with something wrong now and then."""
    s, k = F.col("seq"), F.col("k")
    stamp = F.when(s % 7 == 0, F.concat(F.lit('"'), "timestamp", F.lit('"'))).otherwise(F.col("timestamp").cast("string"))
    item = F.concat(
        F.lit('{"id":"'), "id", F.lit('",'), F.when(s % 11 == 0, "").otherwise(F.concat(F.lit('"component":"'), "component", F.lit('",'))),
        F.lit('"action":"'), "action", F.lit('","source":"app","sessionId":"'), "session_id", F.lit('","timestamp":'), stamp,
        F.when(s % 3 == 0, F.lit(',"channel":"satellite"')).otherwise(F.concat(F.lit(',"channel":"'), "channel", F.lit('"'))),
        F.when(s % 2 == 0, F.lit(',"kind":"error","error":{"boundary":"b","name":"N","message":"m","fingerprint":" fp  1 "}')).otherwise(F.lit(',"kind":"other"')),
        F.when(s % 5 == 0, F.lit(',"context":"text"')).otherwise(F.concat(F.lit(',"context":{"k":'), k.cast("string"), F.lit("}"))), F.lit("}"),
    )
    value = F.when(s % 13 == 0, item).when(s % 17 == 0, F.lit("[broken")).otherwise(F.concat(F.lit("["), item, F.lit(',{"id":1}]')))
    return tables.events(spark, d).select(F.col("seq").alias("queue"), value.alias("value"))


def queue_restore(spark, d):
    r = restore.restore_queue(_persisted(spark, d), CFG)
    return r.select("queue", "id", "component", "action", "session_id", "kind", "channel", "runtime", "timestamp", "context", F.col("error.fingerprint").alias("fingerprint"), F.col("error.severity").alias("severity"))


_ALL = (
    events_normalize, events_mixed_channels, events_component_bound, events_disabled, events_with_error, errors_normalize, errors_extract, errors_to_records, errors_context, errors_gated,
    context_merge, context_inject, context_redact, context_breadth, context_tree, context_tree_native, identifiers_explode, endpoint_secure, batch_admission, queue_cap, flush_batches, flush_envelopes, queue_restore,
    redact_text, sanitize_single_line, sanitize_multiline, tags_normalize, storage_key, string_hash, storage_hash, fingerprint, crash_identity,
    issue_reports, issue_reports_panes, issue_reports_ranked, issue_reports_ranked_all, issue_reports_of_errors, issue_window_count, issue_window_count_late, issue_triggers, issue_triggers_late, issue_seeded,
)


def _with_settings(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(settings(spark), sf_dir)

    run.__name__ = f.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _with_settings(f) for f in _ALL}
