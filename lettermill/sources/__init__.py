"""Readers that turn stored mail and task tables into operator inputs."""
