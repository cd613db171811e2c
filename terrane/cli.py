"""Command line: `python -m terrane COMMAND`."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models, tools
from .chat import Chat, sources_line, system_prompt
from .operators import areas as A
from .operators import watch as W
from .project import Project, ProjectError
from .sources.documents import load_questions

#: Which snippet registers the tool server with which program: a title, and the text for a command and its arguments.
CLIENTS = {
    "claude-desktop": ("add to claude_desktop_config.json", lambda c, a: as_json({"mcpServers": {"terrane": {"command": c, "args": a}}})),
    "claude-code": ("run in a terminal", lambda c, a: " ".join(["claude mcp add terrane --", c, *a])),
    "hermes": ("add to ~/.hermes/config.yaml", lambda c, a: f"mcp_servers:\n  terrane:\n    command: {json.dumps(c)}\n    args: {json.dumps(a)}"),
    "openclaw": ("add to ~/.openclaw/openclaw.json", lambda c, a: as_json({"mcp": {"servers": {"terrane": {"command": c, "args": a}}}})),
    "http": ("start this, then use its address", lambda c, a: " ".join([c, *a, "--http"]) + f"\n# http://127.0.0.1:{tools.PORT}/mcp"),
}


def as_json(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def session() -> SparkSession:
    """The session in use, or a quiet local one; standard output stays free for the tool server's messages."""
    found = SparkSession.getActiveSession()
    if found is None:
        found = SparkSession.builder.appName("terrane").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        found.sparkContext.setLogLevel("ERROR")
    return found


class Commands:
    """Each public method is a command and returns the text to print."""

    def __init__(self, args: argparse.Namespace):
        self.args = args
        self.project = Project(session(), args.root)
        if args.command not in ("init", "build"):
            self.project.ensure_fresh(0)

    def _model(self) -> models.Model:
        return models.required(self.args.provider, self.args.model)

    def _listing(self) -> str:
        lines = []
        for r in rows(self.project.areas().orderBy("ord")):
            lines.append(f"{r['label']}  id={r['id']}  {r['source']}  {r['documents']} documents  [{r['authority']}]")
            details = (r["description"], "words: " + ", ".join(r["aliases"][:10]), "signals: " + "; ".join(r["signals"][:6]) if r["signals"] else "")
            lines += [f"  {d}" for d in details if d]
        return "\n".join(lines) or "no documents found"

    def build(self) -> str:
        s = self.project.build()
        return f"{s['documents']} documents, {s['chunks']} passages, {s['domains']} areas ({s['seconds']} s)"

    def init(self) -> str:
        built = self.build()
        self.project.save_config(self.project.config())
        return f"{built}\n\n{self._listing()}"

    def areas(self) -> str:
        return as_json(rows(A.area_summary(self.project.areas().orderBy("ord")))) if self.args.json else self._listing()

    domains = areas

    def area(self) -> str:
        key = self.project.area(self.args.area)
        found = rows(self.project.areas().where(F.col("id") == key).drop("ord", "alias_stems", "first_docs"))[0]
        docs = self.project.members().where(F.col("id") == key).select("doc").distinct().orderBy("doc")
        return as_json(found | {"docs": [r["doc"] for r in rows(docs)]})

    def rename(self) -> str:
        self.project.edit(self.args.area, label=self.args.label, description=self.args.description)
        return f"renamed to {self.args.label}"

    def trust(self) -> str:
        self.project.edit(self.args.area, authority=self.args.mode, watch_url=self.args.url)
        return f"{self.args.area}: {self.args.mode}"

    def _phrases(self, kind: str) -> str:
        for phrase in self.args.phrases:
            self.project.edit(self.args.area, **{kind: phrase})
        return f"{kind}: " + "; ".join(self.project.config()["domains"][self.project.area(self.args.area)][kind])

    def signal(self) -> str:
        return self._phrases("signals")

    def alias(self) -> str:
        return self._phrases("aliases")

    def enrich(self) -> str:
        return "\n".join(f"{r['id']}: failed ({r['error']})" if r["error"] else f"{r['label'] or r['id']}: {r['description']}\n  {'; '.join(r['signals'])}" for r in rows(self.project.enrich(self._model(), self.args.area or "")))

    def resolve(self) -> str:
        context = self.project.context(self.args.text, max_passages=self.args.k)
        return as_json(context.to_dict()) if self.args.json else context.render()

    def ask(self) -> str:
        context = self.project.context(self.args.question, max_passages=self.args.k)
        reply = self._model().complete(system_prompt(context), [{"role": "user", "content": self.args.question}])
        return reply + (f"\n\n{sources_line(context)}" if context.passages else "")

    def chat(self) -> str:
        Chat(self.project, self._model(), not self.args.no_check, self.args.verbose).run()
        return ""

    def check(self) -> str:
        context = self.project.context(*(t for t in (self.args.question, self.args.draft) if t))
        found = self.project.conflicts(self._model(), self.args.draft, context)
        return "\n".join(f"draft: {c['draft_says']}\n  documents: {c['documents_say']} ({c['doc']})" for c in found) or "no contradiction with the documents"

    def watch(self) -> str:
        lines = []
        for r in self.project.check_watches(self.args.accept):
            lines.append(f"{r['label']} {r['url']}: {r['status']}" + (f" ({r['detail']})" if "detail" in r else ""))
            if "lines_added" in r:
                lines.append(f"  +{r['lines_added']} / -{r['lines_removed']} lines")
                lines += [f"  {sign} {x[:120]}" for sign, part in (("-", "sample_removed"), ("+", "sample_added")) for x in r[part]]
            if "saved_to" in r:
                lines.append(f"  saved to {r['saved_to']}")
            elif r["status"] not in ("error", "unchanged"):
                lines.append("  look it over, then run watch --accept to add it to the documents")
        return "\n".join(lines) or "no area is in mode watch: trust AREA watch --url URL"

    def eval(self) -> str:
        if self.args.generate:
            found = rows(self.project.write_questions(self._model(), self.args.per_doc, self.args.limit))
            Path(self.args.generate).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in found), encoding="utf-8")
            return f"{len(found)} questions written to {self.args.generate}"
        if not self.args.questions:
            raise ProjectError("give a file of questions, or --generate FILE")
        asked = load_questions(self.project.spark, f"file://{Path(self.args.questions).resolve()}")
        outcome = W.outcome(self.project.evaluate(asked, self.args.k)).persist()
        total, kinds = rows(W.recall(outcome))[0], {}
        for r in rows(outcome.select("question", "expect", "baseline_hit", "engine_hit", "active", "bucket").orderBy("question")):
            kinds.setdefault(r.pop("bucket"), []).append(r)
        outcome.unpersist()
        if self.args.json:
            every = sorted((r for kind in kinds.values() for r in kind), key=lambda r: r["question"])
            return as_json({"k": self.args.k, **total, **{b: kinds.get(b, []) for b in ("rescued", "lost", "both_missed")}, "rows": every})
        lines = [f"{total['questions']} questions, {self.args.k} passages each", f"plain search: {total['baseline_recall']:.1%}", f"with areas:   {total['engine_recall']:.1%}"]
        for name in ("rescued", "lost", "both_missed"):
            lines += [f"{name} ({len(kinds[name])})", *(f"  {r['question']} -> {r['expect']}" for r in kinds[name][:10])] if name in kinds else []
        return "\n".join(lines)

    def mcp(self) -> str:
        tools.serve(self.project, models.configured(), self.args.http, self.args.host, self.args.port)
        return ""


def connect(args: argparse.Namespace) -> str:
    chosen = CLIENTS if args.client == "all" else {args.client: CLIENTS[args.client]}
    command = ["-m", "terrane", "--root", str(Path(args.root).resolve()), "mcp"]
    return "\n\n".join(f"{name}: {title}\n{text(sys.executable, command)}" for name, (title, text) in chosen.items())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="terrane", description="Find which of a folder's documents a conversation needs.")
    top.add_argument("--root", default=os.environ.get("TERRANE_ROOT", "."), help="the documents' folder")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *plain: str, asks: bool = False, **options) -> None:
        p = sub.add_parser(name, help=about)
        p.add_argument("--root", default=argparse.SUPPRESS)
        for argument in plain:
            p.add_argument(argument.rstrip("?+"), **({"nargs": argument[-1]} if argument[-1] in "?+" else {}))
        for option, settings in options.items():
            p.add_argument(("-" if len(option) == 1 else "--") + option.replace("_", "-"), **({"action": "store_true"} if settings is None else settings))
        if asks:
            p.add_argument("--provider", help="anthropic, xai or openai; the first with a key otherwise")
            p.add_argument("--model")

    number = {"type": int, "default": None}
    add("init", "index a folder and list its areas", "folder?")
    add("build", "index again")
    add("areas", "list the areas", json=None)
    add("domains", "the same", json=None)
    add("area", "show one area", "area")
    add("rename", "name an area", "area", "label", description={})
    add("trust", "set how far to trust an area: " + ", ".join(A.MODES), "area", "mode", url={})
    add("signal", "add phrases that call for an area", "area", "phrases+")
    add("alias", "add words that name an area", "area", "phrases+")
    add("enrich", "let a model name areas and write their phrases", asks=True, area={})
    add("resolve", "show what a text calls for", "text", k=number, json=None)
    add("ask", "ask one question", "question", asks=True, k=number)
    add("chat", "talk in the terminal", asks=True, no_check=None, verbose=None)
    add("check", "check a draft against the documents", "draft", asks=True, question={})
    add("watch", "look for changes of published sources", accept=None)
    add("eval", "compare with plain search", "questions?", asks=True, k={"type": int, "default": 6}, json=None, generate={"metavar": "FILE"}, per_doc={"type": int, "default": 2}, limit={"type": int, "default": 40})
    add("mcp", "run the tool server", http=None, host={"default": "127.0.0.1"}, port={"type": int, "default": tools.PORT})
    add("connect", "print snippets that register the tool server", "client?")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    if args.command == "init":
        args.root = args.folder or args.root
    if args.command == "connect":
        args.client = args.client or "all"
        if args.client not in (*CLIENTS, "all"):
            sys.exit(f"terrane: unknown client; known: {', '.join(CLIENTS)}")
        print(connect(args))
        return
    try:
        text = getattr(Commands(args), args.command)()
    except (ProjectError, models.ModelError) as e:
        sys.exit(f"terrane: {e}")
    except KeyboardInterrupt:
        sys.exit(130)
    if text:
        print(text)


def serve_main() -> None:
    """The tool server as a command of its own."""
    main(["mcp", *sys.argv[1:]])
