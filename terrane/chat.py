"""A conversation in the terminal whose every turn is resolved against the documents first."""

from __future__ import annotations

from collections.abc import Callable

from .context import Context
from .models import Model, ModelError
from .project import Project

SYSTEM = """You are a helpful assistant who writes plainly. Before each answer, the user's own documents are searched, also in
areas that the user did not name, and what looks relevant follows. Use it where it helps, cite it as [n], and pass over the
rest. Where the documents and your general knowledge differ, say so instead of choosing in silence."""
HELP = "/areas  /context  /check on|off  /clear  /quit"


def system_prompt(context: Context) -> str:
    return f"{SYSTEM}\n\n{context.render()}"


def sources_line(context: Context) -> str:
    return "sources: " + "; ".join(f"[{p['n']}] {p['doc']}{'' if p['via'] == 'question' else '*'}" for p in context.passages)


class Chat:
    """State of one conversation. ask(prompt) reads a line and raises EOFError at the end; say(line) shows one."""

    def __init__(self, project: Project, model: Model, check: bool = True, verbose: bool = False, ask: Callable[[str], str] = input, say: Callable[[str], None] = print):
        self.project, self.model, self.check, self.verbose, self.ask, self.say = project, model, check, verbose, ask, say
        self.history: list[dict] = []
        self.context: Context | None = None

    def run(self) -> None:
        self.say(f"{self.model}, {self.project.areas().count()} areas in {self.project.root}. {HELP}")
        while True:
            try:
                line = self.ask("you> ").strip()
            except (EOFError, KeyboardInterrupt):
                return
            if line in ("/quit", "/exit", "/q"):
                return
            if line.startswith("/"):
                self.command(line)
            elif line:
                self.answer(line)

    def command(self, line: str) -> None:
        name, _, rest = line.partition(" ")
        if name == "/areas":
            for r in self.project.areas().orderBy("ord").select("id", "label", "authority", "documents").collect():
                self.say(f"{r.id}  {r.label}  [{r.authority}]  {r.documents} documents")
        elif name == "/context":
            self.say(self.context.render() if self.context else "nothing yet")
        elif name == "/check":
            self.check = rest.strip() == "on"
            self.say(f"contradiction check {'on' if self.check else 'off'}")
        elif name == "/clear":
            self.history, self.context = [], None
            self.say("conversation cleared")
        else:
            self.say(HELP)

    def answer(self, line: str) -> None:
        self.project.ensure_fresh()
        context = self.project.context(*(m["content"] for m in self.history if m["role"] == "user"), line)
        for area in context.active:
            self.say(f"area: {area['label']}" + (f" ({'; '.join(area['reasons'])})" if area["reasons"] else ""))
        for area in context.parked:
            self.say(f"left out: {area['label']}")
        if self.verbose:
            self.say(context.render())
        for area in context.ask_areas:
            if self.ask(f"Use your documents on '{area['label']}', an ask-first area? [Y/n] ").strip().lower().startswith("n"):
                context = context.without(area["id"])
        self.context = context
        asked = [*self.history, {"role": "user", "content": line}]
        try:
            reply = self.model.complete(system_prompt(context), asked)
        except ModelError as e:  # the turn does not count
            self.say(f"error: {e}")
            return
        self.history = [*asked, {"role": "assistant", "content": reply}]
        self.say(reply)
        if context.passages:
            self.say(sources_line(context))
        if self.check and any(a["authority"] in ("project", "watch") for a in context.active):
            try:
                found = self.project.conflicts(self.model, reply, context)
            except ModelError:
                found = []
            for c in found:
                self.say(f"conflict: the answer says {c['draft_says']}; the documents say {c['documents_say']}" + (f" [{c['passage']}] {c['doc']}" if c["passage"] else ""))
