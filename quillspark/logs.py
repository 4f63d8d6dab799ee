"""Log files of the engine, of a user and of a user's dataset, which begin anew when they have grown."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler

SHAPE = "%(asctime)s %(levelname)s %(name)s %(message)s"


def logger(folder: str, user: str | None = None, dataset: str | None = None, size: int = 10 << 20, kept: int = 5) -> logging.Logger:
    """The driver's logger of its kind: one file for all, or for a user, or for one of their datasets."""
    parts = [p for p in ("quillspark", user, dataset) if p]
    found = logging.getLogger(".".join(parts))
    path = os.path.join(folder, *parts[1:], "log.txt")
    if not any(isinstance(h, RotatingFileHandler) and h.baseFilename == os.path.abspath(path) for h in found.handlers):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handler = RotatingFileHandler(path, maxBytes=size, backupCount=kept, encoding="utf-8")
        handler.setFormatter(logging.Formatter(SHAPE))
        found.addHandler(handler)
        found.setLevel(logging.INFO)
    return found
