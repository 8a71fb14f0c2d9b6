"""A log file that rotates at five mebibytes, with three backups."""

from __future__ import annotations

import logging
from logging.handlers import RotatingFileHandler

MOST_BYTES, BACKUPS = 5 << 20, 3


def file_logger(path: str, name: str = "codeloom", most: int = MOST_BYTES, backups: int = BACKUPS) -> logging.Logger:
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        handler = RotatingFileHandler(path, maxBytes=most, backupCount=backups)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log
