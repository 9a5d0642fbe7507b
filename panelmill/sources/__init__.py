"""Readers, sinks and adapters from raw tables to panel-shaped views."""
