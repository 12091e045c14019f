"""Parameters of the workflow: defaults, a ``key = value # comment`` file, and overrides."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    quality: int = 20
    minlen: int = 15
    modetrm: int = 1  # 0: 5' only, 1: 3' only, 2: both
    mmrate: float = 0.1
    wtrim: int = 0
    wsize: int = 3
    minovlps: int = 5
    mapq: int = 10
    exclclipping: int = 0
    cmplmin: float = 0.0
    sitelenratio: float = 0.1
    nrgmax: float = 0.0
    clustdist: int = 0


def parse_config(text: str) -> dict[str, str]:
    """The pairs of a config text; section lines, blank lines and comments are left out, the last value counts."""
    out = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].strip()
        if "=" in body:
            key, value = body.split("=", 1)
            out[key.strip()] = value.strip()
    return out


def load_params(config: str = "", **overrides) -> Params:
    """Overrides win over the config text, which wins over the defaults; unknown keys are ignored in the text only."""
    kinds = {f.name: type(f.default) for f in fields(Params)}
    known = {k: kinds[k](v) for k, v in parse_config(config).items() if k in kinds}
    return replace(Params(), **known, **overrides)
