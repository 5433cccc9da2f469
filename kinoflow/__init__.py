"""Scene and keyframe analytics over tables of ordered image frames, on Spark."""
