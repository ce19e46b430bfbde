"""Readers, normalisers and sinks (operators S2-S8)."""

from dxlens.sources.sinks import materialise, publish
from dxlens.sources.text import read_billdata, read_descr, read_disch, read_pldata, read_relats

__all__ = ["read_descr", "read_relats", "read_pldata", "read_disch", "read_billdata", "publish",
           "materialise"]
