"""Readers and writers: fixture facts, season files, reports, snapshots, history."""
