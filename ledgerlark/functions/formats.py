"""Display formats for reports."""

from __future__ import annotations


#: Below each limit: what a second is in the unit, decimals, unit.
PRECISE = ((1e-6, 1e9, 0, "ns"), (1e-3, 1e6, 2, "us"), (1.0, 1e3, 2, "ms"), (float("inf"), 1.0, 3, "s"))


def elapsed(seconds: float) -> str:
    """A measured time: ``850.00ms``, ``12.340s``."""
    _, scale, digits, unit = next(p for p in PRECISE if seconds < p[0])
    return f"{seconds * scale:.{digits}f}{unit}"


def duration(seconds: float) -> str:
    """A time as progress has it: ``12.3s``, ``1m 2s``, ``1h 2m``, ``1d 2h 3m``."""
    if seconds < 60:
        return f"{seconds:.1f}s"
    whole = int(seconds)
    parts = [(whole // 86400, "d"), (whole // 3600 % 24, "h"), (whole // 60 % 60, "m"), (whole % 60, "s")]
    # from the largest unit that it has, and seconds only below an hour
    first = next(i for i, (n, _) in enumerate(parts) if n)
    return " ".join(f"{n}{unit}" for n, unit in parts[first : 4 if whole < 3600 else 3])


def size(n: float) -> str:
    """Bytes in units of 1024."""
    if n < 1024:
        return f"{n:.0f} B"
    power = next((k for k in (1, 2) if n < 1024 ** (k + 1)), 3)
    return f"{n / 1024**power:.2f} {('KB', 'MB', 'GB')[power - 1]}"


def share(part: float, whole: float) -> float:
    """``part`` of ``whole`` in percent; 0 of nothing."""
    return 100 * part / whole if whole else 0.0


def rate(n: float, seconds: float) -> float:
    return n / seconds if seconds > 0 else 0.0
