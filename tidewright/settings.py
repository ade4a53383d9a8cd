"""Where data lies and how the engine logs: from the environment, read once."""

from __future__ import annotations

import logging
import os
import time
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    root: str
    log_level: str = "INFO"

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])


def project_root(start: str | os.PathLike | None = None) -> str:
    """The nearest folder at or above ``start`` that holds a .git or pyproject.toml, else ``start`` itself."""
    at = Path(start or os.getcwd()).resolve()
    for folder in (at, *at.parents):
        if (folder / ".git").exists() or (folder / "pyproject.toml").exists():
            return str(folder)
    return str(at)


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    level = os.environ.get("TIDEWRIGHT_LOG_LEVEL", "INFO").upper()
    if not isinstance(logging.getLevelName(level), int):
        raise ValueError(f"no log level: {level}")
    return Settings(os.environ.get("TIDEWRIGHT_ROOT") or f"{project_root()}/data", level)


def bar_root(spark) -> str:
    """The folder of the bar store. The default, a folder of the driver's project, is for one process only: on a cluster TIDEWRIGHT_ROOT has to name one that all share."""
    if not os.environ.get("TIDEWRIGHT_ROOT") and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("TIDEWRIGHT_ROOT must name a folder that driver and executors share")
    return get_settings().path("bars")


def setup_logging(level: str | None = None) -> logging.Logger:
    """One handler with times in UTC; a second call changes the level only."""
    log = logging.getLogger("tidewright")
    if not log.handlers:
        handler = logging.StreamHandler()
        shown = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        shown.converter = time.gmtime
        handler.setFormatter(shown)
        log.addHandler(handler)
    log.setLevel(level or get_settings().log_level)
    return log
