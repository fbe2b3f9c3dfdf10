"""Reusable grouped and ordered operators; every one of them tolerates a key holding most rows."""
