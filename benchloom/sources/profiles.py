"""Device profiles: JSON documents that say how a kind of file is read and how it is recognised."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import PurePath

from benchloom.sources.files import reader_for
from benchloom.sources.sniff import decode


@dataclass(frozen=True)
class Profile:
    """``hints`` are texts that the head of a file must hold, one ``pattern`` fits its name; ``options`` go to the reader."""

    name: str
    reader: str
    pattern: str | tuple[str, ...] = "*"
    hints: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    @staticmethod
    def from_json(text: str) -> "Profile":
        d = json.loads(text)
        if unknown := set(d) - set(Profile.__dataclass_fields__):
            raise KeyError(f"unknown keys: {', '.join(sorted(unknown))}")
        if isinstance(d.get("pattern"), list):
            d["pattern"] = tuple(d["pattern"])
        return Profile(**{**d, "hints": tuple(d.get("hints", ()))})

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    def fits(self, name: str) -> bool:
        patterns = (self.pattern,) if isinstance(self.pattern, str) else self.pattern
        return any(fnmatch.fnmatch(PurePath(name).name.lower(), p.lower()) for p in patterns)


def matching(profiles: Iterable[Profile], name: str, head: bytes, text: str | None = None) -> list[Profile]:
    """Profiles of the file's reader whose pattern and hints fit, most hints first; hints are looked for in ``text``, else the first 16 KiB."""
    reader = reader_for(head, name)
    text = decode(head[: 1 << 14], len(head) > 1 << 14)[0] if text is None else text
    hits = [p for p in profiles if p.reader == reader and p.fits(name) and all(h in text for h in p.hints)]
    return sorted(hits, key=lambda p: (-len(p.hints), p.name))


def detect(profiles: Iterable[Profile], name: str, head: bytes, text: str | None = None) -> Profile | None:
    return next(iter(matching(profiles, name, head, text)), None)
