"""Broadcasting behind a count."""

from tessera.runtime import BROADCAST_ROWS, small  # noqa: F401
