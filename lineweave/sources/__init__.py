"""Scans: scripts, check tables, frames and configuration."""
