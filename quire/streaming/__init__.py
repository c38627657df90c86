"""Streams into stores."""
