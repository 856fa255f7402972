"""Simulators and planners that run inside Arrow tasks, one episode or member per row."""
