"""Options that a session or the environment may set: `textframes.<name>` in the session, `TEXTFRAMES_<NAME>` (dots as underscores) outside."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import SparkSession


def _real(text: str) -> float:
    return float(text)


def _whole(text: str) -> int:
    if (n := int(text)) < 1:
        raise ValueError(text)
    return n


def _switch(text: str) -> bool:
    return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[text.strip().lower()]


def _separation(text: str) -> str:
    """`1` or `contrast`, `2` or `binary`; anything else leaves images as they are."""
    return {"1": "contrast", "contrast": "contrast", "2": "binary", "binary": "binary"}.get(text.strip().lower(), "raw")


#: Of each option: its names, the first that is set counts, what reads its text, and whether a value given in code goes first.
HOOKS: dict[str, tuple[tuple[str, ...], Callable[[str], Any], bool]] = {
    "gamma": (("segmentation.gamma",), _real, False),
    "input_gamma": (("input.gamma",), _real, False),
    "input_separation": (("input.separation",), _separation, False),
    "merge_separation": (("merge.separation", "input.separation"), _separation, False),
    "fill_width": (("input.width",), _whole, True),
    "batch_rows": (("input.batch",), _whole, False),
    "threads": (("input.threads",), _whole, True),
    "dual_pipeline": (("chunks.enabled",), _switch, True),
    "profile": (("profile",), _switch, True),
}


def resolved(given: Mapping[str, Any], spark: SparkSession | None = None, environment: Mapping[str, str] | None = None) -> tuple[dict[str, Any], dict[str, str]]:
    """given (option: value, None for not given) with what settings say, and a note for each setting that was read.

    For each name the session comes before the environment. A value that can't be read is ignored, and
    noted as such. A value given in code counts where nothing is set, or first if the option says so.
    """
    environment = os.environ if environment is None else environment
    out, notes = {k: v for k, v in given.items() if v is not None}, {}
    for option, (names, read, code_first) in HOOKS.items():
        if code_first and option in out:
            continue
        for name in names:
            session, outside = f"textframes.{name}", "TEXTFRAMES_" + name.upper().replace(".", "_")
            for place, text in ((session, spark.conf.get(session, None) if spark else None), (outside, environment.get(outside))):
                if text is None or text == "":
                    continue
                try:
                    out[option] = read(text)
                except (ValueError, KeyError):
                    notes[option] = f"{place}={text} ignored"
                    continue
                notes[option] = f"{place}={text}"
                break
            else:
                continue
            break
    return out, notes
