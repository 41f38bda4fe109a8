"""Readers and writers: folders of files, observation sheets, report tables, logs and dumps."""
