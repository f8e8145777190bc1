"""Where pages, images and stored graphs come from, and where stages are written."""
