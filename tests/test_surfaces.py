"""Models, operators that ask them, watched sources, contexts, tools, chat, command line and streams."""

from __future__ import annotations

import io
import json
import sys
import threading
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle

from terrane import cli, models
from terrane.chat import Chat
from terrane.operators import assist as S
from terrane.operators import watch as W
from terrane.project import Project
from terrane.streaming.conversations import keep_fresh, recent_turns, resolve_stream, windows_as_turns
from terrane.tools import Tools, http_server, paragraphs, serve_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need the fake model

FILES = {
    "house/plumbing.md": "# Plumbing\n\nDrip the faucets so that pipes do not freeze. The main valve is in the basement.",
    "car/tires.md": "# Tires\n\nSwap to winter tires before the first cold snap.",
    "insurance/policy.md": "# Policy\n\nThe deductible for storm damage is 500.",
}


class Fake:
    """Replies with fixed text, or fails on prompts that hold `fails`."""

    def __init__(self, reply: str, fails: str = "\0"):
        self.reply, self.fails = reply, fails

    def complete(self, system, messages, max_tokens=2048, temperature=None):
        if self.fails in messages[-1]["content"]:
            raise models.ModelError("no answer")
        return self.reply


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("surface")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    p = Project(spark, str(root))
    p.build()
    return p


def test_public_names():
    import terrane

    assert terrane.Project is Project and terrane.__version__ and set(terrane.__all__) <= {*dir(terrane), "Context", "Project", "ProjectError"}
    assert issubclass(terrane.ProjectError, Exception) and terrane.Context().render().startswith("No area")
    with pytest.raises(AttributeError):
        terrane.nothing


def test_configured_models():
    assert models.configured(env={}) is None
    assert str(models.configured("Claude", "m", {"ANTHROPIC_API_KEY": "k"})) == "anthropic:m"
    assert models.configured(env={"XAI_API_KEY": "k", "TERRANE_BASE_URL": "http://x"}).service == "xai"
    local = models.configured("openai", "m", {"TERRANE_BASE_URL": "http://x/v1/"})
    assert (local.base, local.key) == ("http://x/v1/", "")
    for name, env in (("nobody", {}), ("grok", {}), ("openai", {}), ("openai", {"OPENAI_API_KEY": "k"})):
        with pytest.raises(models.ModelError):
            models.configured(name, None, env)


def test_request_shapes(monkeypatch):
    sent = []
    answers = {"messages": {"content": [{"type": "text", "text": "hi"}, {"type": "other"}]}, "completions": {"choices": [{"message": {"content": "yo"}}]}}
    monkeypatch.setattr(models, "post", lambda url, headers, body: sent.append((url, headers, body)) or answers[url.rsplit("/", 1)[1]])
    ask = [{"role": "user", "content": "q"}]
    assert models.HttpModel("anthropic", "m", models.MESSAGES_URL, "k", "messages").complete("s", ask, temperature=0) == "hi"
    assert models.HttpModel("openai", "m", "http://x/v1/", "k").complete("s", ask, temperature=0) == "yo"
    assert "temperature" not in sent[0][2] and sent[0][1]["x-api-key"] == "k" and sent[0][2]["system"] == "s"
    assert sent[1][0] == "http://x/v1/chat/completions" and sent[1][2]["temperature"] == 0 and sent[1][2]["messages"][0] == {"role": "system", "content": "s"}
    monkeypatch.setattr(models, "post", lambda *_: {"error": "x"})
    with pytest.raises(models.ModelError):
        models.HttpModel("openai", "m", "http://x").complete("s", ask)


def test_patiently_tries_again_only_what_passes():
    pauses, answers = [], [models.ModelError("busy", True), models.ModelError("busy", True, 7.0), "yes"]

    def call():
        answer = answers.pop(0)
        if isinstance(answer, models.ModelError):
            raise answer
        return answer

    assert models.patiently(call, sleep=pauses.append) == "yes" and 0.5 <= pauses[0] <= 1 and pauses[1] == 7
    answers = [models.ModelError("wrong key")]
    with pytest.raises(models.ModelError, match="wrong key"):
        models.patiently(call, sleep=pauses.append)
    answers = [models.ModelError("busy", True)] * 3
    with pytest.raises(models.ModelError, match="busy"):
        models.patiently(call, tries=3, sleep=pauses.append)
    assert not answers and len(pauses) == 4


def test_ask_missing_asks_only_what_has_no_reply(spark, tmp_path):
    """A stand-in service counts what it is asked: it is busy at first, refuses one prompt, and is never asked twice for a reply."""
    asked, lock = [], threading.Lock()

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            prompt = body["messages"][-1]["content"]
            with lock:
                asked.append(prompt)
                status = 503 if asked.count(prompt) == 1 and prompt == "p1" else 400 if prompt == "bad" and not mended else 200
            answer = json.dumps({"choices": [{"message": {"content": f"re {prompt}"}}]}).encode()
            self.send_response(status)
            self.send_header("retry-after", "0")
            self.send_header("content-length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    mended = False
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model, kept = models.HttpModel("own", "m", f"http://127.0.0.1:{server.server_port}"), f"file://{tmp_path}/kept"
        prompts = spark.createDataFrame([(i, f"p{i % 5}") for i in range(8)] + [(8, "bad"), (9, None)], "id int, prompt string")
        got = {r.id: (r.reply, r.error) for r in S.ask_missing(prompts, model, "s", 5, kept, wave=2).collect()}
        assert len(got) == 10 and all(got[str(i)] == (f"re p{i % 5}", None) for i in range(8)) and got["9"] == (None, None)
        assert got["8"][0] is None and "answered 400" in got["8"][1]
        assert sorted(asked) == ["bad", "p0", "p1", "p1", "p2", "p3", "p4"]
        asked.clear()
        mended = True
        more = prompts.union(spark.createDataFrame([(10, "new")], prompts.schema))
        again = {r.id: r.reply for r in S.ask_missing(more, model, "s", 5, kept).collect()}
        assert sorted(asked) == ["bad", "new"] and again["8"] == "re bad" and again["10"] == "re new" and again["3"] == "re p3"
        asked.clear()
        assert S.ask_missing(prompts.limit(0), model, "s", 5, kept).count() == 0 and not asked
    finally:
        server.shutdown()


def test_ask_model_keeps_the_batch(spark):
    prompts = spark.createDataFrame([("a", "fine"), ("b", "bad one")], "id string, prompt string")
    got = {r.id: r for r in S.ask_model(prompts, Fake("hi", fails="bad"), "s", 5).collect()}
    assert (got["a"].reply, got["a"].error, got["b"].reply, got["b"].error) == ("hi", None, None, "no answer")
    assert S.ask_model(prompts.limit(0), Fake("hi"), "s", 5).count() == 0


def test_parsed_replies(spark):
    replies = spark.createDataFrame([("a", '```json\n{"label": " House ", "signals": ["it is cold", "", 3]}\n```', None), ("b", "none", None), ("c", None, "down"), ("d", "[1, 2]", None)], "id string, reply string, error string")
    got = {r.id: r for r in S.enrichments(replies).collect()}
    assert (got["a"].label, got["a"].description, got["a"].signals, got["a"].error) == ("House", "", ["it is cold"], None)
    assert got["b"].error and got["c"].error == "down" and got["d"].error
    passages = spark.createDataFrame([("a", 1, "x.md", "t")], "query_id string, n int, doc string, text string")
    text = '{"conflicts": [{"draft_says": "5", "documents_say": "6", "passage": "1"}, {"passage": null}, {"passage": 9}, {"passage": 1.0}, {"passage": "1.0"}, 7]}'
    found = S.conflicts(spark.createDataFrame([("a", text, None), ("b", "chatter", None)], replies.schema), passages).collect()
    assert sorted((r.passage or 0, r.doc) for r in found) == [(0, ""), (0, ""), (1, "x.md"), (1, "x.md"), (9, "")]
    drafts = spark.createDataFrame([("a", "it is 5"), ("b", "no passages")], "query_id string, draft string")
    assert [r.prompt for r in S.draft_prompts(drafts, passages).collect()] == ["EXCERPTS\n[1] (x.md) t\n\nDRAFT\nit is 5"]
    assert [tuple(r) for r in S.questions(spark.createDataFrame([("d.md", '["q1", 2, "q2"]', None)], replies.schema), 1).collect()] == [("q1", "d.md")]


def test_enrichment_survives_a_rebuild(project):
    found = project.enrich(Fake('{"label": "Home", "description": "d", "signals": ["the boiler sings"]}', fails="Area: car")).collect()
    assert {r.id: r.error for r in found} == {"house": None, "insurance": None, "car": "no answer"}
    project.build()
    kept = {r.id: (r.label, r.signals) for r in project.areas().collect()}
    assert kept["house"] == ("Home", ["the boiler sings"]) and kept["car"] == ("Car", [])
    assert "house" in [a["id"] for a in project.context("the boiler sings again").active]
    questions = project.write_questions(Fake('["where is the valve"]'), 2, 1).collect()
    assert [tuple(r) for r in questions] == [("where is the valve", "car/tires.md")]


def test_context_and_chat(project):
    project.edit("insurance", authority="ask")
    context = project.context("storm damage deductible")
    assert [a["id"] for a in context.ask_areas] == ["insurance"] and "HIGH-STAKES" in context.render()
    refused = context.without("insurance")
    assert not refused.ask_areas and all(p["domain_id"] != "insurance" for p in refused.passages)
    assert context.to_dict()["passages"][0]["doc"] == "insurance/policy.md"
    assert "general knowledge" in project.context("zzz").render()
    said, lines = [], iter(["/areas", "/context", "storm damage deductible", "swap to winter tires", "/check off", "/clear", "/help", "/quit"])
    reply = '{"conflicts": [{"draft_says": "a", "documents_say": "b", "passage": 1}]}'
    chat = Chat(project, Fake(reply), ask=lambda prompt: "n" if "[Y/n]" in prompt else next(lines), say=said.append)
    chat.run()
    shown = "\n".join(said)
    assert "nothing yet" in shown and "[1] car/tires.md" in shown and "conflict: the answer says a" in shown and chat.history == [] and not chat.check
    failing = Chat(project, Fake("x", fails="winter"), ask=lambda _: "", say=said.append)
    failing.answer("winter tires")
    assert failing.history == [] and said[-1] == "error: no answer"


def test_watches(project):
    project.edit("car", authority="watch", watch_url="http://example.org/a")
    page = {"http://example.org/a": "one\ntwo"}
    run = lambda accept=False: project.check_watches(accept, fetch=lambda url: page[url])
    first = run()
    assert [(r["id"], r["status"], r["lines_added"], r["lines_removed"]) for r in first] == [("car", "new", 2, 0)]
    assert run()[0]["status"] == "awaiting review"
    assert run(True)[0]["saved_to"] == "car/_watched_car.md" and "two" in (project.root / "car/_watched_car.md").read_text()
    assert run(True)[0]["status"] == "unchanged"
    page["http://example.org/a"] = "one\nthree"
    changed = run()[0]
    assert (changed["status"], changed["sample_added"], changed["sample_removed"]) == ("changed", ["three"], ["two"])
    del page["http://example.org/a"]
    assert run()[0]["status"] == "error"
    page["http://example.org/a"] = "one\nthree"
    assert run()[0]["status"] == "awaiting review"
    project.edit("car", authority="project")


def test_fetch_reads_html(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text("<html><body><h1>T</h1><p>a &amp; b</p></body></html>")
    rows = spark.createDataFrame([("x", page.as_uri()), ("y", "file:///nowhere")], "id string, url string")
    got = {r.id: r for r in W.fetch_sources(rows).collect()}
    assert got["x"].text == "# T\n\na & b" and got["y"].error and got["y"].text is None


def test_tools(project):
    project.edit("insurance", authority="ask")
    call = lambda name, **a: {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}
    sent = [{"id": 0, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call("search", query="faucets", area="house"), call("read_document", path="../x"), call("add_signal", area="house", phrase="leaving town"), call("resolve", conversation="hello\n\nleaving town"), call("check_draft", draft="the deductible is 900"), call("_call"), {"id": 3, "method": "nothing"}]
    sink = io.StringIO()
    serve_lines(Tools(project), io.StringIO("\n".join(json.dumps(m) for m in sent) + "\nnot json\n"), sink)
    hello, listed, found, refused, signal, resolved, checked, hidden, unknown, broken = [json.loads(x) for x in sink.getvalue().splitlines()]
    names = {t["name"] for t in listed["result"]["tools"]}
    assert names == {"resolve", "list_areas", "search", "read_document", "check_draft", "add_signal", "set_authority"}
    text = lambda r: r["result"]["content"][0]["text"]
    assert text(found).startswith("[1] house/plumbing.md") and refused["result"]["isError"] and "leaving town" in text(signal)
    assert "house/plumbing.md" in text(resolved) and "insurance/policy.md" in text(checked)
    assert hidden["error"]["code"] == -32602 and unknown["error"]["code"] == -32601 and broken["error"]["code"] == -32700
    assert "the same" not in hello and json.loads(Tools(project).list_areas())[0]["id"] == "car"
    conflict = Tools(project, Fake('{"conflicts": [{"draft_says": "900", "documents_say": "500", "passage": 1}]}')).check_draft("the deductible is 900")
    assert "| insurance/policy.md | 500 | 900 |" in conflict and Tools(project, Fake('{"conflicts": []}')).check_draft("the deductible is 900").endswith("agree")


def test_turns_of_a_conversation():
    assert paragraphs("a\nb\n \n\nc") == ["a\nb", "c"] and paragraphs(" \n\n ") == [""]


def test_tools_over_http(project):
    server = http_server(Tools(project), "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/mcp", json.dumps({"id": 5, "method": "ping"}).encode())
    assert json.load(urllib.request.urlopen(request, timeout=30)) == {"jsonrpc": "2.0", "id": 5, "result": {}}
    server.shutdown()


def test_command_line(project, tmp_path, capsys, monkeypatch):
    def run(*arguments):
        cli.main(["--root", str(project.root), *arguments])
        return capsys.readouterr().out

    assert "3 areas" in run("build") and "id=house" in run("areas")
    assert json.loads(run("area", "house"))["id"] == "house"
    run("rename", "car", "My car")
    run("alias", "car", "wheels")
    assert "engine light" in run("signal", "my car", "engine light", "flat")
    assert json.loads(run("resolve", "the engine light is on", "--json"))["active_domains"][0]["label"] == "My car"
    assert "training" in run("trust", "car", "training")
    questions = tmp_path / "q.jsonl"
    questions.write_text('# note\n{"question": "storm damage deductible", "expect": "policy"}\n')
    assert json.loads(run("eval", str(questions), "--json"))["engine_recall"] == 1.0
    assert "plain search" in run("eval", str(questions)) and "no area is in mode watch" in run("watch")
    monkeypatch.setattr(models, "required", lambda *_: Fake('["q"]'))
    assert run("ask", "storm damage deductible").startswith('["q"]') and "no contradiction" in run("check", "the deductible is 900")
    assert run("eval", "--generate", str(tmp_path / "g.jsonl"), "--limit", "1").startswith("2 ") or (tmp_path / "g.jsonl").read_text()
    assert "mcpServers" in run("connect", "claude-desktop") and "mcp add" in run("connect")
    for bad in (["area", "nowhere"], ["trust", "car", "sometimes"], ["eval"], ["connect", "nobody"]):
        with pytest.raises(SystemExit):
            run(*bad)


def test_streams(spark, project, tmp_path):
    source, seen = tmp_path / "turns", []
    schema = "query_id string, turn long, text string"
    for rows in ([("a", 2, "dog"), ("a", 1, "engine"), ("b", 1, ""), ("b", 2, None)], [("a", i, f"t{i}") for i in range(3, 9)] + [("b", 3, "storm damage deductible")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))

        def write(active, passages, number):
            seen.append(passages.where("n = 1").select("query_id", "doc").collect())

        resolve_stream(project, stream, write, str(tmp_path / "checkpoint")).awaitTermination()
    assert [("b:3", "insurance/policy.md")] == [tuple(r) for batch in seen for r in batch if r.query_id.startswith("b")]
    windows = recent_turns(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    windows.awaitTermination()
    got = {(r.query_id, r.turn): r.texts for r in spark.table("windows").collect()}
    assert got["a", 8] == [f"t{i}" for i in range(3, 9)] and got["a", 1] == ["engine"] and ("b", 1) not in got
    assert windows_as_turns(spark.table("windows")).where("query_id = 'a:8'").count() == 6


def test_keep_fresh(project, tmp_path):
    (project.root / "house" / "roof.md").write_text("# Roof\n\nShingles were laid in May.")
    query = keep_fresh(project, str(tmp_path / "ticks"), 1)
    try:
        until = time.time() + 90
        while project.is_stale() and time.time() < until:
            time.sleep(1)
        assert not project.is_stale()
    finally:
        query.stop()
