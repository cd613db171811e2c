"""A PySpark-native document-context engine: Project, resolve, Context and ProjectError are its Python interface."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"
__all__ = ["Context", "Project", "ProjectError", "resolve"]
_HOMES = {"Context": ".context", "Project": ".project", "ProjectError": ".project"}


def __getattr__(name: str):
    """Public names are imported when they are asked for: workers that need one operator load nothing else."""
    if name not in _HOMES:
        raise AttributeError(f"module {__name__} has no attribute {name}")
    return getattr(import_module(_HOMES[name], __name__), name)


def resolve(project, *texts: str, max_passages: int | None = None):
    """The Context that one conversation, oldest turn first, gets from a Project's documents."""
    return project.context(*texts, max_passages=max_passages)
