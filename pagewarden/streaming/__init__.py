"""The same steps on unbounded inputs."""
