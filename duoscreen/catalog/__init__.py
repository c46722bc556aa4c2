"""All registered queries."""

from duoscreen.catalog import files, models, scores, screens, studies  # noqa: F401
from duoscreen.catalog.base import QUERIES  # noqa: F401
