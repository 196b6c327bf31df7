"""Connected components, as the library's own functions find them."""

from __future__ import annotations

from stocklens.functions.components import components

__all__ = ["components"]
