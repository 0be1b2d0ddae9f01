"""Logs and files as they come: task marks paired by keyed state, append-only logs, folders that are listed again and again."""
