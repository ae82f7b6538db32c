"""Models: classifiers, detectors, thresholds."""
