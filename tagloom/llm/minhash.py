"""The former name of nearcopies.py, whose candidates came from MinHash."""

from tagloom.llm.nearcopies import similar_classes  # noqa: F401
